"""Queries over strings, JSON and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import text as tx
from tramline.operators import joins as jn

from .registry import query, table

_D = "text"
_LOW = "lower(text)"


@query("prj_01_split_ids", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS ids FROM documents")
def _(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.array_join(tx.split_ids(F.col("text"), ","), "|").alias("ids"))


@query("prj_02_parse_list", "SELECT s_suppkey, 'a' || s_suppkey || '|b' || s_nationkey AS ids FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("['a%d', 'b%d']", F.col("s_suppkey"), F.col("s_nationkey"))).otherwise(F.format_string("a%d, b%d", F.col("s_suppkey"), F.col("s_nationkey")))
    return s.select("s_suppkey", F.array_join(tx.parse_list(raw), "|").alias("ids"))


@query("prj_03_agent_id", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE CAST(s_suppkey AS VARCHAR) END AS id FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.col("s_suppkey").cast("string"), F.lit(".0"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" "), F.col("s_suppkey").cast("string"))).otherwise("  ")
    return s.select("s_suppkey", tx.agent_id(raw).alias("id"))


@query("prj_04_finite_or_null", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS DOUBLE) / 4 END AS v FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, (k / 4).cast("string")).when(k % 4 == 1, "NaN").when(k % 4 == 2, "-Infinity").otherwise("n/a")
    return s.select("s_suppkey", tx.finite_or_null(raw).alias("v"))


@query(
    "prj_05_split_dataset",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'set_a' ELSE 'set_a_' || CASE p_partkey % 3 WHEN 1 THEN 'odd' END END AS name, CAST(NULL AS VARCHAR) AS split FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, 'set_a', 'train' FROM part WHERE p_partkey % 3 = 2",
)
def _(spark, d):
    p = table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, "set_a").when(F.col("p_partkey") % 3 == 1, "set_a_odd").otherwise("set_a_train")
    name, split = tx.split_dataset(raw)
    return p.select("p_partkey", name.alias("name"), split.alias("split"))


@query("prj_06_scene_index", "SELECT s_suppkey, CAST(s_suppkey AS INT) AS scene FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    a = F.when(k % 3 == 0, k.cast("string")).otherwise("x")
    b = F.when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("val_scene_"), k.cast("string")))
    return s.select("s_suppkey", tx.scene_index(a, b).alias("scene"))


@query("prj_07_original_names", "SELECT p_partkey, regexp_replace(p_type, '^(train|val|test)_', '') || ';' || p_brand AS track FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'val_' ELSE '' END || p_type AS p_type, p_brand FROM part)")
def _(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "val_").otherwise(""), "p_type")
    return p.select("p_partkey", F.array_join(F.array(tx.without_split_prefix(raw), F.col("p_brand")), ";").alias("track"))


@query("prj_08_ego_resolution", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN n_regionkey ELSE c_custkey END AS agent FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("ego"))
    name = F.when(F.col("c_custkey") % 10 == 0, "ego").otherwise(F.col("c_custkey").cast("string"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.when(name == "ego", F.col("ego")).otherwise(name.try_cast("long")).alias("agent"))


@query("prj_09_kind_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")


@query("prj_11_annotation_filter", "SELECT conv_id, array_to_string(list(role ORDER BY turn) FILTER (WHERE role <> 'system'), '|') AS kept FROM conversations GROUP BY conv_id")
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    kept = F.array_join(F.transform(F.filter("r", lambda x: ~x["role"].rlike("^system$")), lambda x: x["role"]), "|")
    return g.select("conv_id", F.nullif(kept, F.lit("")).alias("kept"))


@query(
    "prj_12_gated_projection",
    "SELECT o_orderkey, o_totalprice AS price, o_orderpriority AS section FROM orders WHERE o_orderstatus = 'F'",
)
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    r = o.select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("section")).alias("result"))
    return r.select("o_orderkey", "result.*")


@query("prj_13_valid_or_reject", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'reject' ELSE 'ok' END AS outcome, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, 'none') AS evidence FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    e = F.coalesce(F.when(k == 0, F.col("o_orderpriority")), F.when(k == 1, F.col("o_orderstatus")), F.lit("none"))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "reject").otherwise("ok").alias("outcome"), e.alias("evidence"))


@query("prj_14_line_upgrade", f"SELECT doc_id, array_to_string(list_filter(string_split({_D}, chr(10)), lambda l: NOT regexp_matches(l, '^(Licensed|Copyright)|token =')), chr(10)) AS body FROM documents")
def _(spark, d):
    kept = F.filter(F.split(F.col("text"), "\n"), lambda x: ~x.rlike("^(Licensed|Copyright)|token ="))
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, "\n").alias("body"))


@query("prj_16_sampled_polyline", "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CAST(floor(i * 63 / 9.0) AS BIGINT)), ',') AS picked, CAST(embedding[8] AS DOUBLE) AS second FROM embeddings")
def _(spark, d):
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor(i * 63 / 9)))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(at.cast("array<string>"), ",").alias("picked"), F.get("embedding", F.get(at, 1).cast("int")).cast("double").alias("second"))


@query("prj_17_safe_names", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') AS file FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.safe_name(F.concat("p_name", F.lit(" / "), "p_type")).alias("file"))


@query(
    "prj_19_record_validator",
    "WITH t AS (SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi, list(DISTINCT role ORDER BY role) AS roles FROM conversations GROUP BY 1) SELECT conv_id, n = hi - lo + 1 AND lo = 0 AS dense, len(list_filter(roles, lambda r: r NOT IN ('user', 'assistant', 'system'))) AS strange FROM t",
)
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.collect_set("role").alias("roles"))
    known = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    return g.select("conv_id", ((F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("lo") == 0)).alias("dense"), F.size(F.array_except("roles", known)).cast("long").alias("strange"))


@query("prj_20_review_filter", f"SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE (regexp_matches({_LOW}, 'stupid|idiot') OR regexp_matches(text, '@[a-z0-9]+[.]')) AND quality = 1 AND lang IN ('en', 'de')")
def _(spark, d):
    t = table(spark, d, "documents").where((F.lower("text").rlike("stupid|idiot") | F.col("text").rlike("@[a-z0-9]+[.]")) & F.col("lang").isin("en", "de"))
    return t.join(table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("txt_01_code_fences", "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10)) AS body FROM documents WHERE length(text) > 0")
def _(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.trim(F.col("text"), F.lit(" \t\n")), F.lit("\n```"))
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", tx.strip_fences(fenced).alias("body"))


@query("txt_02_word_count", f"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) AS words FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"))


def _by(which, *texts: str):
    """The text of this number."""
    return F.element_at(F.array(*map(F.lit, texts)), (which + 1).cast("int"))


@query(
    "txt_03_pair_semantics",
    "WITH c AS (SELECT o_orderkey AS k, 'vehicle ' || (o_orderkey % 7) || CASE o_orderkey % 8 WHEN 0 THEN ' followed the bus' WHEN 1 THEN ' near Vehicle 03' WHEN 2 THEN ' passes and leads' WHEN 3 THEN ' cut  in ahead' WHEN 4 THEN ' merges' WHEN 5 THEN ' merges with it' WHEN 6 THEN ' gives way' ELSE ' overtook' END AS t FROM orders) SELECT k, CASE k % 8 WHEN 1 THEN k % 7 <> 3 WHEN 2 THEN false WHEN 4 THEN false ELSE true END AS pair FROM c",
)
def _(spark, d):
    k = F.col("o_orderkey")
    t = F.concat(F.lit("vehicle "), (k % 7).cast("string"), _by(k % 8, " followed the bus", " near Vehicle 03", " passes and leads", " cut  in ahead", " merges", " merges with it", " gives way", " overtook"))
    return table(spark, d, "orders").select(k.alias("k"), tx.names_others(t, k % 7).alias("pair"))


@query("txt_08_result_schema", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 90, false) AS ok FROM events")
def _(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(k.between(0, 90), F.lit(False)).alias("ok"))


@query("txt_09_prompt_hash", "SELECT p_partkey, sha256('Describe ' || p_name || ' of ' || p_brand || '.') AS digest FROM part")
def _(spark, d):
    _, digest = tx.prompt(F.lit("Describe {name} of {brand}."), name=F.col("p_name"), brand=F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", digest.alias("digest"))


@query("txt_10_generation_routing", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'insufficient' WHEN c_acctbal < 100 THEN 'stationary_template' WHEN c_nationkey < 3 THEN 'model_suspicious' ELSE 'model' END AS route FROM customer")
def _(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b < 0, "insufficient").when(b < 100, "stationary_template").when(F.col("c_nationkey") < 3, "model_suspicious").otherwise("model").alias("route"))


@query("txt_12_description_cells", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS start_frame, coalesce(try_cast(json_extract_string(props, '$.end') AS BIGINT), 90) AS end_frame FROM events")
def _(spark, d):
    cell = F.from_json("props", "k bigint, end bigint")
    w = F.array(F.struct(F.coalesce(cell["k"], F.lit(0)).alias("s"), F.coalesce(cell["end"], F.lit(90)).alias("e")))
    return table(spark, d, "events").select("event_id", F.explode(w).alias("w")).select("event_id", F.col("w.s").cast("long").alias("start_frame"), F.col("w.e").cast("long").alias("end_frame"))


@query("txt_13_corrected_dataset", "SELECT doc_id, CASE WHEN toxic = 0 AND quality = 1 THEN n_chars WHEN toxic = 0 THEN n_chars * 2 ELSE n_chars END AS n, CASE WHEN toxic IS NULL THEN 'unchecked' WHEN quality = 1 THEN 'correct' ELSE 'edited' END AS source FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic = 0")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left").where("toxic is null or toxic = 0")
    edited = (F.col("toxic") == 0) & (F.col("quality") != 1)
    return j.select("doc_id", F.when(edited, F.col("n_chars") * 2).otherwise(F.col("n_chars")).alias("n"), F.when(F.col("toxic").isNull(), "unchecked").when(edited, "edited").otherwise("correct").alias("source"))


@query("txt_14_upsert_review", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0) UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 5 = 0")
def _(spark, d):
    base = table(spark, d, "labels").select("doc_id", "quality")
    return jn.upsert(base, table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("quality")), ["doc_id"])
