"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail and IP addresses, card and phone numbers) come from fixed patterns with checks. They seed the rest:
the word before a seed, the two words before it and the word after it are lexical patterns. Patterns beside enough different
seeds are looked up beside all words that may be identifiers. Patterns and these instances form a graph that is scored in
rounds: a pattern by the share of its occurrences that stand beside seeds or good instances, an instance by the patterns
beside it. Patterns with a high score name identifiers that no base pattern knows; those are added as spans of the kind
``context``. Base spans always stay.

Positions count code points. They are summed from the pieces between matches, as ``split`` and ``regexp_extract_all`` give
them for the same pattern. The patterns below find what the plain ones find, but pass over a long run of characters once:
a match may only begin where a run begins or the last match ended. Their loops over groups are possessive or bounded, as
Java's others take a stack frame a repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: A pattern needs so many different seeds. What stands beside them by chance is told by its score: the share of its own
#: occurrences that seeds or good instances stand beside, which doesn't depend on the corpus' size.
MIN_SEEDS = 5
#: A pattern at this score or more finds identifiers.
CONFIDENCE = 0.6
ROUNDS = 4
#: Characters on either side of a span in which its patterns are looked for.
WINDOW = 80
#: Bits of the table that keeps most words and word pairs that are no pattern from being counted, whatever their number.
TABLE_BITS = 20
#: Matches whose places are summed in one array.
RUN = 256

# The kinds' patterns.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+){3}"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
_PHONE = r"\+(?=(?:[ ().-]*[0-9]){10,15}[ ().-]*(?![ ().0-9-]))[0-9][ ().0-9-]+[0-9]"

#: A word of six characters or more with a digit.
_MAYBE = r"(?<!\S)(?=\S*[0-9])\S{6,}"
#: Punctuation at a word's ends, but colon, equals and number sign.
_OUTER = r"(?<!\S)[^\p{L}\p{N}:=#\s]++|(?<![^\p{L}\p{N}:=#\s])[^\p{L}\p{N}:=#\s]++(?!\S)"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """The pattern's matches in turn: (p, m, left, right, start, end), the piece of text before it, the match, up to ``WINDOW``
    characters on either side (three pieces and matches at most) and its place."""

    def near(x: Column) -> Column:
        piece = lambda i: F.coalesce(F.get(x["pieces"], i), F.lit(""))
        match = lambda i: F.coalesce(F.get(x["found"], i), F.lit(""))
        last = lambda c: F.when(F.char_length(c) > WINDOW, F.substring(c, -WINDOW, WINDOW)).otherwise(c)
        first = lambda c: F.substring(c, 1, WINDOW)
        return F.transform(
            x["found"],
            lambda m, i: F.struct(
                piece(i).alias("p"),
                m.alias("m"),
                last(F.concat(last(match(i - 2)), last(piece(i - 1)), last(match(i - 1)), last(piece(i)))).alias("left"),
                first(F.concat(first(piece(i + 1)), first(match(i + 1)))).alias("right"),
            ),
        )

    def size(x: Column) -> Column:
        return F.char_length(x["p"]) + F.char_length(x["m"])

    def sums(values: Column) -> Column:
        """What comes before each of the values."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def placed(rows: Column) -> Column:
        """Sums within runs of a fixed length and over the runs, so that no array grows with each match."""
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda c: F.slice(rows, c * RUN + 1, F.lit(RUN)))

        def place(run: Column, before: Column) -> Column:
            return F.zip_with(
                run, sums(F.transform(run, size)), lambda x, at: F.struct(x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"), (before + at + F.char_length(x["p"])).alias("start"), (before + at + size(x)).alias("end"))
            )

        return _let(cut, lambda cut: F.flatten(F.zip_with(cut, sums(F.transform(cut, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + size(x)))), place)))

    pieces = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<struct<m:string,left:string,right:string,start:int,end:int>>")
    return _let(_let(pieces, near), lambda rows: F.when(F.size(rows) > 0, placed(rows)).otherwise(none))


def _found(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's matches that ``keep`` holds for."""
    spans = F.filter(_matches(text, pattern), lambda x: keep(x["m"]))
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    at = F.sequence(F.lit(1), F.char_length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _octets(match: Column) -> Column:
    """Every part is 255 at most, leading zeros apart."""
    return F.forall(F.split(match, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """All base spans with their matched text and what stands beside it, by start, then kind in the order of ``KINDS``."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,m:string,left:string,right:string>>")
    yes = lambda m: F.lit(True)
    digits = text.rlike("[0-9]")
    return F.sort_array(
        F.concat(
            F.when(F.contains(text, F.lit("@")), _found(text, _EMAIL, 0, yes)).otherwise(none),
            F.when(digits & text.rlike(r"[0-9]\.[0-9]"), _found(text, _IP, 1, _octets)).otherwise(none),
            F.when(digits & text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), _found(text, _CARD, 2, _luhn)).otherwise(none),
            F.when(F.contains(text, F.lit("+")), _found(text, _PHONE, 3, yes)).otherwise(none),
        )
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(_id, _hash, _text): rows that share the first two count as repeated."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text")).withColumn("_hash", F.xxhash64("_text"))


def normal(text: Column) -> Column:
    """Lower case, digits alike, words without outer punctuation; words of punctuation alone vanish."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), _OUTER, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(normal(text), r"\s+"), lambda w: w != "")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")


def _may_be(word: Column) -> Column:
    """Six characters or more, four digits among them or both letters and digits."""
    digits = F.char_length(F.regexp_replace(word, "[^0-9]+", ""))
    return (F.char_length(word) >= 6) & ((digits >= 4) | ((digits > 0) & word.rlike(r"\p{L}")))


def context_patterns(left: Column, right: Column) -> Column:
    """The patterns that these surroundings hold: the last word and the last two of ``left``, the first of ``right``, if
    they have a letter. A word that the window cuts is none."""
    before = _words(F.when(F.char_length(left) >= WINDOW, F.regexp_replace(left, r"^\S*", "")).otherwise(left))
    after = _words(F.when(F.char_length(right) >= WINDOW, F.regexp_replace(right, r"\S*$", "")).otherwise(right))

    def build(x: Column) -> Column:
        n = F.size(x["before"])
        one, two, next_ = F.get(x["before"], n - 1), F.get(x["before"], n - 2), F.get(x["after"], F.lit(0))
        all_ = F.array(F.concat(F.lit("l "), one), F.concat(F.lit("l "), two, F.lit(" "), one), F.concat(F.lit("r "), next_))
        return F.filter(all_, lambda p: p.isNotNull() & F.substring(p, 3, 2 * WINDOW).rlike(r"\p{L}"))

    return _let(F.struct(before.alias("before"), after.alias("after")), build)


def _apart(words: Column, base: Column) -> Column:
    """The words, in order of place, that overlap no base span. A run of words meets the spans about it only."""

    def over(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def of_run(run: Column) -> Column:
        whole = F.struct(F.get(run, F.lit(0))["start"].alias("start"), F.get(run, F.size(run) - 1)["end"].alias("end"))
        return _let(F.filter(base, lambda b: over(b, whole)), lambda near: F.filter(run, lambda w: ~F.exists(near, lambda b: over(b, w))))

    def runs(words: Column) -> Column:
        n = F.size(words)
        size = F.greatest(F.lit(RUN), F.ceil(F.sqrt(n)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda c: F.slice(words, c * size + 1, size))
        return F.flatten(F.transform(cut, of_run))

    return _let(words, lambda words: F.when((F.size(words) > 0) & (F.size(base) > 0), runs(words)).otherwise(words))


def occurrences(keyed: DataFrame) -> DataFrame:
    """(_id, _hash, start, end, word, seed, pattern): base entities (``seed``) and other words that may be identifiers, without
    outer punctuation, once for each pattern beside them."""
    text = F.col("_text")
    rows = keyed.where(text.rlike("[@0-9]")).select("_id", "_hash", base_spans(text).alias("base"), _matches(text, _MAYBE).alias("words"))

    def seed(b: Column) -> Column:
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), b["m"].alias("word"), F.lit(True).alias("seed"), context_patterns(b["left"], b["right"]).alias("patterns"))

    def word(w: Column) -> Column:
        lead = F.char_length(w["m"]) - F.char_length(F.regexp_replace(w["m"], r"^[^\p{L}\p{N}]+", ""))
        core = _core(w["m"])
        start = w["start"] + lead
        return F.struct(start.alias("start"), (start + F.char_length(core)).alias("end"), core.alias("word"), F.lit(False).alias("seed"), context_patterns(w["left"], w["right"]).alias("patterns"))

    apart = _apart(F.filter("words", lambda w: _may_be(_core(w["m"]))), F.col("base"))
    found = rows.select("_id", "_hash", F.explode(F.concat(F.transform("base", seed), F.transform(apart, word))).alias("o"))
    return found.select("_id", "_hash", "o.start", "o.end", "o.word", "o.seed", F.explode("o.patterns").alias("pattern"))


def seed_patterns(found: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, seeds, seen): the patterns beside enough different base entities."""
    pairs = found.where("seed").groupBy("pattern", "word").agg(F.count("*").alias("n"))
    return pairs.groupBy("pattern").agg(F.count("*").alias("seeds"), F.sum("n").alias("seen")).where(F.col("seeds") >= min_seeds)


def _key(words: Column) -> Column:
    return F.xxhash64(words)


def _bit_table(patterns: DataFrame) -> Column:
    """The patterns' hashes in a table of ``TABLE_BITS`` bits, 64 to a number; at most 2^14 numbers come to the driver."""
    slot = F.col("h").bitwiseAND(F.lit((1 << TABLE_BITS) - 1).cast("long"))
    rows = patterns.select(F.shiftright(slot, 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    table = [0] * (1 << TABLE_BITS - 6)
    for r in rows.groupBy("i").agg(F.bit_or("bit").alias("bits")).collect():
        table[r["i"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to a constant


def pattern_totals(keyed: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern's words occur in all texts."""
    wanted = patterns.select("pattern", F.substring("pattern", 3, 2 * WINDOW).alias("w")).withColumn("h", _key(F.col("w")))
    table = _bit_table(wanted)

    def kept(h: Column) -> Column:
        at = F.shiftright(h.bitwiseAND(F.lit((1 << TABLE_BITS) - 1).cast("long")), 6).cast("int")
        return F.get(table, at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0

    def hashes(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), _key(F.concat(a, F.lit(" "), b))))
        return F.filter(F.concat(F.transform(w, _key), pairs), lambda h: h.isNotNull() & kept(h))

    counts = keyed.select(F.explode(_let(_words(F.col("_text")), hashes)).alias("h")).groupBy("h").agg(F.count("*").alias("total"))
    return wanted.join(counts, "h").select("pattern", "total")


def score_graph(totals: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score): rounds of scoring over the graph of patterns and instances.

    ``totals``: (pattern, total), how often a pattern occurs. ``edges``: (pattern, word, n), how often it stands beside a word
    that may be an identifier. ``seeds``: (pattern, seen), how often beside a base entity. A pattern starts with its share of
    seeds. An instance is good unless all patterns beside it fail; a pattern gets its good instances, weighed by its share of
    seeds, added to the seeds, over its total.
    """
    known = totals.join(seeds.select("pattern", "seen"), "pattern").select("pattern", "total", F.least("seen", "total").alias("base"))
    patterns = materialize(known.select("pattern", "total", "base", (F.col("base") / F.col("total")).alias("score")), "patterns")
    for _ in range(rounds):
        instances = edges.join(patterns.select("pattern", "score"), "pattern").groupBy("word").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("good"))
        support = edges.join(instances, "word").groupBy("pattern").agg(F.sum(F.col("n") * F.col("good")).alias("support"))
        share = F.col("base") / F.col("total")
        patterns = materialize(
            patterns.drop("score").join(support, "pattern", "left").select("pattern", "total", "base", F.least(share + F.coalesce("support", F.lit(0.0)) * share / F.col("total"), F.lit(1.0)).alias("score")),
            "patterns",
        )
    return patterns.select("pattern", "score")


def discovered(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(_id, _hash, more): for texts with any, the spans of identifiers that confident patterns name; None if no pattern is confident."""
    keyed = _keyed(docs)
    found = materialize(occurrences(keyed), "occurrences")
    seeds = materialize(seed_patterns(found, min_seeds), "seeds")
    if seeds.isEmpty():
        return None
    # each pattern and instance is one row before it meets the patterns
    pairs = found.where("not seed").groupBy("pattern", "word").agg(F.count("*").alias("n"))
    edges = materialize(pairs.join(seeds.select("pattern"), "pattern"), "edges")
    scores = score_graph(pattern_totals(keyed, seeds), edges, seeds)
    good = materialize(scores.where(F.col("score") >= confidence).select("pattern"), "good")
    if good.isEmpty():
        return None
    hits = found.where("not seed").join(good, "pattern").select("_id", "_hash", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("s"))
    return materialize(hits.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("s")).alias("more")), "hits")  # a text's own, as many as it has


def spans(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans, *keep): base spans and all spans of each row, as arrays of (start, kind, end).

    One row for each row of ``docs``. Null texts count as empty, and have no spans; repeated rows have the same spans. A word
    that overlaps a base span is never discovered. ``keep``: columns of ``docs`` to pass on.
    """
    hits = discovered(docs, min_seeds, confidence)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), *keep)
    bare = F.transform(base_spans(F.col("_text")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    if hits is None:
        return rows.select(F.col("_id").alias("doc_id"), bare.alias("base"), *keep).withColumn("spans", F.col("base"))
    rows = rows.withColumn("_hash", F.xxhash64("_text")).alias("r")
    hits = hits.alias("h")
    both = rows.join(hits, F.col("r._id").eqNullSafe(F.col("h._id")) & (F.col("r._hash") == F.col("h._hash")), "left")
    both = both.select(F.col("r._id").alias("doc_id"), bare.alias("base"), "more", *keep)
    return both.select("doc_id", "base", *keep, F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def _joined(spans_: str) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, CONTEXT)))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows: counts of each kind, the digest of the base spans, and all spans."""

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return spans(docs).select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; other columns as they were, null texts too.

    ``n_chars``, if there, is counted anew for the rows that change. Of overlapping spans the first hides the others' shared part.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in (*KINDS, CONTEXT)))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    keep = tuple(docs.columns)
    clash = {c: f"_own_{i}" for i, c in enumerate(keep)}
    own = docs.select(*(F.col(f"`{c}`").alias(clash[c]) for c in keep), F.col("doc_id"), F.col("text"))
    found = spans(own, keep=tuple(clash.values()))
    text = F.col(clash["text"])
    out = F.aggregate("spans", begin, lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out")))
    done = F.when(F.size("spans") > 0, F.concat(out["out"], F.substring(text, out["at"] + 1, F.char_length(text)))).otherwise(text)
    found = found.withColumn("_done", done)
    cols = []
    for c in keep:
        col = F.col(clash[c])
        if c == "text":
            col = F.col("_done")
        elif c == "n_chars":
            col = F.when(F.size("spans") > 0, F.char_length("_done").cast(docs.schema[c].dataType)).otherwise(col)
        cols.append(col.alias(c))
    return found.select(*cols)
