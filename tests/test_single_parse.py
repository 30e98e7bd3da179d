import re

import __spark_entry__ as entry_module


def test_a_record_is_parsed_once(spark, sf_dir):
    df = entry_module.queries()["prj_18_structural_validator"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1


def test_a_part_is_taken_once(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from tramline.operators import validation

    told = str(validation.pair_facts_errors(F.col("t"), F.lit(1), F.lit(2)))
    taken = Counter(re.findall(r"try_variant_get\(\w+, '(\$\.[\w.]+)',", told))
    assert len(taken) > 20 and set(taken.values()) == {1}
