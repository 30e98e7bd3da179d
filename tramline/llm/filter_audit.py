"""What a chain of filters removes, in every order: inclusion and exclusion over joint failures.

Each row has one 0/1 flag a filter. One aggregation sums, for all subsets of the filters, the product of their flags: how many
rows fail them jointly. Everything else is arithmetic on those sums, by part and not by row: the rows that survive a set of
filters are the alternating sum over its subsets (the Möbius inversion), a removal is the difference of two survivors, and the
dividend of a subset in the game "rows removed by a set of filters" is its joint count with alternating sign, so that a
filter's Shapley value is the sum of its subsets' dividends, each shared equally. No row is filtered once for each order.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of a word, and the five conditions under which a text fails.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = r"[A-Z]"
SYMBOL = r"[#$%&*|]"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent of the words
MOST_UPPER = 2  # per cent of the code points
FILTERS = "ABCDE"


def text_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, a, b, c, d): the four conditions that a text alone decides, as 0/1, and the text's SHA-256.

    Null texts are empty, a null source is the part ''. An empty text fails a only.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.size("words")
    flags = {
        "a": n < LEAST_WORDS,
        "b": 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
        "c": 100 * F.regexp_count("text", F.lit(UPPER)) > MOST_UPPER * F.char_length("text"),
        "d": F.col("text").rlike(SYMBOL),
    }
    return read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[f.cast("int").alias(k) for k, f in flags.items()])


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, n, good, toxic): counts of rows with equal flags, ``e`` for a text that a smaller id has too.

    Rows of one text have the same four flags, so copies are counted together before any row moves by its text: by id first
    (which the join with the labels has already dealt out), then by part and labels. A text's smallest id is found over those
    counts, so a text that a third of all rows share costs a few rows. A row without an id has no smaller id, and fails no ``e``.
    Several label rows of an id count as one, with any of their marks. Equal ids of one text are none the smaller.
    """
    of = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = text_flags(docs).join(of, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "a", "b", "c", "d", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low"))
    first = F.col("low") == F.min("low").over(Window.partitionBy("digest"))
    repeated = F.coalesce(F.col("known") - F.when(first, F.col("at_low")).otherwise(0), F.lit(0))
    both = groups.withColumn("_e", repeated).select(
        *kind, F.explode(F.array(F.struct(F.lit(0).alias("e"), (F.col("n") - F.col("_e")).alias("n")), F.struct(F.lit(1).alias("e"), F.col("_e").alias("n")))).alias("_s")
    )
    flags = [F.col(k) for k in ("part", "a", "b", "c", "d")]
    return both.where("_s.n > 0").select(*flags, "_s.e", "_s.n", (F.col("good") * F.col("_s.n")).alias("good"), (F.col("toxic") * F.col("_s.n")).alias("toxic"))


def _product(flags: list[str], subset: int) -> Column:
    return reduce(lambda x, y: x * y, [F.col(f) for i, f in enumerate(flags) if subset >> i & 1], F.lit(1))


def joint_failures(rows: DataFrame, part: str, flags: list[str], counts: list[str]) -> DataFrame:
    """(part, one array a count): element s is the count of rows that fail all filters of subset s (bit i is flag i).

    ``flags`` are 0/1 columns, ``counts`` how much a row counts for. One aggregation with partial sums on the map side.
    """
    subsets = range(1 << len(flags))
    return rows.groupBy(part).agg(*[F.sum(_product(flags, s) * F.col(c)).alias(f"{c}_{s}") for c in counts for s in subsets]).select(part, *[F.array(*[f"{c}_{s}" for s in subsets]).alias(c) for c in counts])


def _sign(subset: Column) -> Column:
    return F.when(F.bit_count(subset) % 2 == 0, 1).otherwise(-1)


def survivors(joint: Column, filters: int) -> Column:
    """Array over all sets of filters: how many rows fail none of the set."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return F.transform(every, lambda p: F.aggregate(every, F.lit(0).cast("long"), lambda acc, t: acc + F.when(t.bitwiseAND(p) == t, _sign(t) * F.get(joint, t)).otherwise(0)))


def shapley(joint: Column, filters: int) -> Column:
    """Array over the filters: rows removed, summed over all orders, from the dividends of the subsets."""
    orders = math.factorial(filters)
    every = F.sequence(F.lit(1), F.lit((1 << filters) - 1))
    share = lambda t: -_sign(t) * F.get(joint, t) * F.get(F.array(F.lit(0), *[F.lit(orders // k) for k in range(1, filters + 1)]), F.bit_count(t))
    return F.transform(F.sequence(F.lit(0), F.lit(filters - 1)), lambda f: F.aggregate(every, F.lit(0).cast("long"), lambda acc, t: acc + F.when(F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", t, f)) == 1, share(t)).otherwise(0)))


def audit(rows: DataFrame, part: str, flags: list[str], names: str, count: str = "n", others: dict[str, str] | None = None) -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant, unique_fails, shapley, and the ``others``.

    ``names`` has a letter for each flag. ``others`` gives further counts of removed rows, result column to count column. All
    counts are whole for any part, however large; the orders are made from the parts' sums only.
    """
    k, others = len(flags), others or {}
    every = (1 << k) - 1
    sums = joint_failures(rows, part, flags, [count, *others.values()])
    kept = sums.select(part, F.col(count).alias("_j"), shapley(F.col(count), k).alias("_v"), survivors(F.col(count), k).alias("_kept"), *[survivors(F.col(c), k).alias(f"_{o}") for o, c in others.items()])
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)]))
    letter = lambda at: F.instr(F.lit(names), F.substring("filter_order", at, F.lit(1))) - 1
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i < F.col("step")), F.lit(0), lambda acc, i: acc + F.pow(F.lit(2), F.call_function("locate", F.call_function("substring", F.col("filter_order"), i, F.lit(1)), F.lit(names)) - 1).cast("int"))
    steps = kept.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumns({"_p": before, "_i": letter(F.col("step"))}).withColumn("_b", F.pow(F.lit(2), F.col("_i")).cast("int"))
    gone = lambda c: F.get(c, F.col("_p")) - F.get(c, F.col("_p") + F.col("_b"))
    removed = gone(F.col("_kept"))
    return steps.select(
        F.col(part).alias("part"), "filter_order", "step", F.get("_kept", F.col("_p") + F.col("_b")).alias("kept"), removed.alias("removed"),
        (F.get("_j", F.col("_b")) - removed).alias("redundant"), (F.get("_kept", F.lit(every) - F.col("_b")) - F.get("_kept", F.lit(every))).alias("unique_fails"),
        *[gone(F.col(f"_{o}")).alias(o) for o in others], F.get("_v", F.col("_i")).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters: 600 rows for each source. An empty table gives no rows."""
    return audit(marked(docs, labels), "part", list("abcde"), FILTERS, "n", {"good_lost": "good", "toxic_lost": "toxic"})


_LETTERS = "SELECT unnest(['A', 'B', 'C', 'D', 'E'])"

#: The same rows the long way: each order is applied filter by filter to counts of equal flags.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters(x) AS ({_LETTERS}),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
fails AS (SELECT o.filter_order, g.*, k.step,
    CASE substr(o.filter_order, k.step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failed
  FROM g, orders o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) k),
firsts AS (SELECT *, coalesce(max(failed::INT) OVER (PARTITION BY filter_order, part, a, b, c, d, e ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone
  FROM fails),
steps AS (SELECT part, filter_order, step,
    CAST(coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (failed AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failed AND a::INT + b::INT + c::INT + d::INT + e::INT = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM firsts GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM steps
"""
