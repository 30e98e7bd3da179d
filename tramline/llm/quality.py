"""Quality rules by robust multivariate outliers: a text's statistics against those of its language and source.

Each text gives a vector of transformed statistics. For all rows, each language, and each source in a language, a minimum
covariance determinant estimate (deterministic starts, then concentration steps) finds the centre and the scatter of the tightest
half of the rows; a row whose Mahalanobis distance from its source's estimate is over the cutoff is rejected. Everything runs as
DataFrame expressions and aggregations. A concentration step is one pass: the moments of all rows are summed by bins of their
distance, with partial sums on the map side, and the bins up to the half are added up afterwards. So a source with any share of
the rows costs its sums only, and no row is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A word, the symbols counted, the rules that need no model.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30  # per cent of the words

#: The spread of each coordinate under which differences don't count: log of words, log of letters a word, square root of symbols a
#: word, arcsine of the root of the share of repeated lines, and of repeated words. Its square is added to each variance, so
#: that a coordinate that is zero for most rows is no exact fit.
RESOLUTION = (0.25, 0.06, 0.08, 0.2, 0.2)
DIM = len(RESOLUTION)
#: Chi-square of five degrees: its upper quantile at one in a million, and the factor by which the scatter of the half nearest to
#: the centre falls short of the normal one's (0.5 over the share of chi-square of seven degrees under the median of five).
CUTOFF = 35.89
CONSISTENCY = 1.9122
#: Rows that the estimate one level up counts for in a group's own.
PRIOR = 30.0
STEPS = 7
#: Bins of a distance's logarithm to base two, and of a coordinate.
DISTANCE_BINS = 16
VALUE_BINS = 64
#: Rows of an estimate that are broadcast at most, and the parts of a key beyond that.
SMALL = 20_000
SALTS = 64

_X = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
_KEY = ["level", "g1", "g2"]


def _paired(hashes: Column, apart: int) -> Column:
    """Hashes of each element and the one ``apart`` places on, as far as there is one."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda x, y: F.xxhash64(x, y))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x0..x4).

    Null texts have no words, and null languages and sources are ''. Windows of eight words are told apart by 64-bit hashes of
    their halves' hashes. The vector is defined for texts with words.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("t"))
    split = read.select("*", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("t", "\n"), lambda s: s.rlike(WORD)).alias("lines"))
    counted = split.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"), F.size("lines").alias("_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    hashed = counted
    for width in (1, 2, 4):  # hashes of two words, then of four, then of eight
        hashed = hashed.withColumn("_h", _paired(F.col("_h"), width))
    hashed = hashed.withColumnRenamed("_h", "_w")
    told = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    again = F.filter("_s", lambda s, i: F.coalesce(F.get("_s", i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == s["h"], F.lit(False)))
    at = told.drop("_w").withColumn("_p", F.sort_array(F.transform(again, lambda s: s["p"]))).drop("_s")
    spans = F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    n_repeat = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s), F.lit(0)).cast("long")
    rows = at.withColumn("n_repeat_words", n_repeat)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n = F.greatest("n_words", F.lit(1)).cast("double")
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.col(part) / whole, F.lit(1.0))))
    vector = [F.log(n), F.log(F.greatest("word_chars", F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), share("n_dup_lines", F.greatest("_lines", F.lit(1))), share("n_repeat_words", n)]
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *[v.alias(x) for x, v in zip(_X, vector)])


def _levels(rows: DataFrame) -> DataFrame:
    """Each row three times: under all rows (level 0), its language (1), its source in the language (2)."""
    none = F.lit("")
    keys = [(0, none, none), (1, F.col("lang"), none), (2, F.col("lang"), F.col("source"))]
    return rows.select(*_X, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("g1"), b.alias("g2")) for k, a, b in keys])).alias("_k")).select("_k.*", *_X)


def _with_estimates(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with their key's rows of the written ``table``, never dealt out by the key alone, as one key has all rows.

    A table of up to SMALL rows (a few hundred bytes each) is broadcast; of a larger one each row is repeated for SALTS parts of its key.
    """
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table), _KEY)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("x0", "x1"), F.lit(SALTS)).cast("int")).join(salted, [*_KEY, "_salt"]).drop("_salt")


def _quartiles(rows: DataFrame) -> DataFrame:
    """(key, c0.., s0..): the median of each coordinate and its spread by the quartiles, from counts by bins of equal width."""
    cells = rows.select(*_KEY, F.posexplode(F.array(*[F.floor(F.col(x) * VALUE_BINS) for x in _X])).alias("i", "bin"))
    counts = cells.groupBy(*_KEY, "i", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*_KEY, "i")
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) / VALUE_BINS
    q = upto.groupBy(*_KEY, "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    spread = lambda i: F.sqrt(F.pow((F.col("high") - F.col("low")) / 1.349, 2) + RESOLUTION[i] ** 2)
    one = lambda v, i: F.max(F.when(F.col("i") == i, v))
    return q.groupBy(*_KEY).agg(*[one(F.col("mid"), i).alias(f"c{i}") for i in range(DIM)], *[one(spread(i), i).alias(f"s{i}") for i in range(DIM)])


def _matrix(entry) -> str:
    return "array(" + ", ".join("array(" + ", ".join(entry(max(i, j), min(i, j)) for j in range(DIM)) + ")" for i in range(DIM)) + ")"


#: Sweeps every pivot of a positive definite matrix: m becomes its negated inverse, d the logarithm of its determinant.
_SWEEP = """aggregate(sequence(0, {last}), struct({matrix} AS m, 0D AS d), (s, k) -> struct(
  transform(s.m, (r, i) -> transform(r, (x, j) -> CASE WHEN i = k AND j = k THEN -1 / x WHEN i = k OR j = k THEN x / s.m[k][k] ELSE x - r[k] * s.m[k][j] / s.m[k][k] END)) AS m,
  s.d + ln(s.m[k][k]) AS d))"""


def _with_inverse(params: DataFrame) -> DataFrame:
    """(key, start, c0.., v_ij, logdet): the inverse of the covariance a_ij, and the logarithm of its determinant."""
    swept = params.withColumn("_s", F.expr(_SWEEP.format(last=DIM - 1, matrix=_matrix(lambda i, j: f"a{i}{j}"))))
    return swept.selectExpr(*_KEY, "start", *[f"c{i}" for i in range(DIM)], *[f"-_s.m[{i}][{j}] AS v{i}{j}" for i, j in _PAIRS], "_s.d AS logdet")


def squared_distance() -> Column:
    """Of x0.. from c0.. by the inverse covariance v_ij."""
    return F.expr(" + ".join(f"{1 if i == j else 2} * v{i}{j} * (x{i} - c{i}) * (x{j} - c{j})" for i, j in _PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts a key: the quartiles' spreads without correlation, and the scatter of directions from the median."""
    q = materialize(_quartiles(rows), "quartiles")
    centre = [f"c{i}" for i in range(DIM)]
    plain = q.selectExpr(*_KEY, "0 AS start", *centre, *[f"{f's{i} * s{i}' if i == j else '0D'} AS a{i}{j}" for i, j in _PAIRS])
    z = _with_estimates(rows, q).selectExpr(*_KEY, *[f"(x{i} - c{i}) / s{i} AS z{i}" for i in range(DIM)])
    unit = z.withColumn("_r", F.expr("greatest(1e-12D, " + " + ".join(f"z{i} * z{i}" for i in range(DIM)) + ")"))
    signs = unit.groupBy(*_KEY).agg(*[F.expr(f"avg(z{i} * z{j} / _r) AS d{i}{j}") for i, j in _PAIRS])
    sign = q.join(signs, _KEY).selectExpr(*_KEY, "1 AS start", *centre, *[f"{DIM} * d{i}{j} * s{i} * s{j} + {RESOLUTION[i] ** 2 if i == j else 0.0}D AS a{i}{j}" for i, j in _PAIRS])
    return _with_inverse(plain.unionByName(sign))


def _moments(rows: DataFrame, params: DataFrame) -> DataFrame:
    """(key, start, n, c0.., a_ij): mean and covariance of the half of a key's rows that is nearest by ``params``."""
    bins = F.floor(F.log2(F.greatest(squared_distance(), F.lit(0.0)) + 1e-9) * (DISTANCE_BINS / 2))
    d = _with_estimates(rows, params).select(*_KEY, "start", bins.alias("bin"), *_X)
    sums = ["count(*) AS n", *[f"sum(x{i}) AS m{i}" for i in range(DIM)], *[f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in _PAIRS]]
    b = d.groupBy(*_KEY, "start", "bin").agg(*map(F.expr, sums))
    w = Window.partitionBy(*_KEY, "start")
    half = b.withColumns({"_upto": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)}).where(f"_upto - n < floor((_all + {DIM + 1}) / 2)")
    m = half.groupBy(*_KEY, "start").agg(*[F.expr(f"sum({c}) AS {c}") for c in ("n", *[f"m{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in _PAIRS])])
    return m.selectExpr(*_KEY, "start", "n", *[f"m{i} / n AS c{i}" for i in range(DIM)], *[f"{CONSISTENCY} * (p{i}{j} / n - m{i} / n * m{j} / n) AS a{i}{j}" for i, j in _PAIRS])


def _with_parent(own: DataFrame, up: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` moments, pooled with PRIOR rows of the estimate one level up."""
    names = [*[f"c{i}" for i in range(DIM)], *[f"a{i}{j}" for i, j in _PAIRS]]
    both = own.join(up.selectExpr(*keys, "start", *[f"{c} AS _{c}" for c in names]), [*keys, "start"]).withColumn("w", F.expr(f"n / (n + {PRIOR}D)"))
    mean = [f"w * c{i} + (1 - w) * _c{i} AS c{i}" for i in range(DIM)]
    cov = [f"w * a{i}{j} + (1 - w) * _a{i}{j} + w * (1 - w) * (c{i} - _c{i}) * (c{j} - _c{j}) AS a{i}{j}" for i, j in _PAIRS]
    return both.selectExpr(*_KEY, "start", "n", *mean, *cov)


def concentration_step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The next estimate of every key and start: moments of the nearest half, pooled with the level above, with RESOLUTION added."""
    own = materialize(_moments(rows, params), "moments")
    top = own.where("level = 0")
    langs = _with_parent(own.where("level = 1"), top, [])
    groups = _with_parent(own.where("level = 2"), langs, ["g1"])
    every = top.unionByName(langs).unionByName(groups)
    return _with_inverse(every.withColumns({f"a{i}{i}": F.expr(f"greatest(a{i}{i}, 0D) + {RESOLUTION[i] ** 2}D") for i in range(DIM)}))


def estimates(rows: DataFrame) -> DataFrame:
    """(level, g1, g2, start, c0.., v_ij, logdet): of the starts the one with the least determinant, for every key.

    ``rows`` have lang, source, x0..x4, without nulls. An empty table gives an empty estimate.
    """
    keyed = _levels(rows)
    params = materialize(_starts(keyed), "mcd")
    for _ in range(STEPS):
        params = materialize(concentration_step(keyed, params), "mcd")
    best = Window.partitionBy(*_KEY).orderBy("logdet", "start")
    return params.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, ``distance`` (squared, null where base_failed) and kept.

    ``distance`` is from the estimate of the document's own source in its language. Rows that fail the base rules are no part of
    any estimate. Equal ids are separate rows; null texts fail the base rules. An empty table gives no rows.
    """
    stats = materialize(text_statistics(docs), "statistics")
    found = estimates(stats.where("not base_failed")).where("level = 2").drop("level", "start", "logdet").withColumnsRenamed({"g1": "lang", "g2": "source"})
    d = stats.join(found, ["lang", "source"], "left")
    distance = F.when(~F.col("base_failed"), squared_distance())
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF)).fillna(False, ["kept"])
