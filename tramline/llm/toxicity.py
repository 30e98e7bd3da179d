"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to classes (insult, threat, target, negation, report, quote, boundary, other). Insult
arcs are stems with weights learned from labelled documents: the log odds of the label given the stem, less its standard
error. Threats are verbs with fixed weights, and count for more where a target stands before or after them. Context
transducers for targets, threats, negation, reported speech and quotation rewrite matches to their kind, and are composed
into one deterministic machine. It runs over the clauses that hold an insult or a threat; what it emits for a clause, the
kind and weight of each match, is summed to the document's features, one for each kind. A logistic regression on these gives
the score; a target or a threat never lowers it, negation and report never raise it (``PRIOR``, ``LEAST``). Labels are only used for rows of the
training fold, and a training row's stems are weighed without the row itself.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, tidy

#: Stems of words: so many characters, or the whole word.
STEMS = range(3, 9)
#: A stem needs so many toxic training documents.
MIN_SUPPORT = 3
#: Standard errors by which a stem's weight is lowered.
CAUTION = 1.5
MIN_WEIGHT = 0.25
RIDGE = 0.2
#: Bound of the labelled rows that the model is fitted on (a sample by the ids' hash if there are more). It bounds the lexicon too.
FIT_ROWS = 50_000
#: Stem counts a task holds before it hands them on.
HELD_COUNTS = 250_000
MEMO_LIMIT = 150_000

# Closed-class words of English, German, French and Spanish.
NEGATION = frozenset("not no never none neither nor isn aren wasn don doesn didn won cannot without nicht kein keine keinen nie niemals ohne ne pas jamais sans non nunca jamás tampoco sin".split())
REPORT = frozenset("said says say saying told wrote writes claimed claims quoted quote called reported according sagte sagt schrieb laut zitiert dit disait écrit selon dijo dice escribió según".split())
TARGET = frozenset("you your yours yourself u ya he she him her they them their this these those people everyone du dich dir dein deine ihr euch sie er tu toi te ton vous vos votre il elle ils elles tú usted ustedes ellos ellas él ella".split())
# Threat verbs by weight. The English "die" isn't among them, as it is the commonest German article.
GRAVE = frozenset("kill murder shoot stab töten umbringen ermorden erschießen tuer assassiner matar asesinar".split())
HARSH = frozenset("destroy hurt beat burn hang schlagen vernichten sterben détruire frapper mourir crever destruir golpear morir".split())
THREAT = {**dict.fromkeys(GRAVE, 2.0), **dict.fromkeys(HARSH, 1.0)}

OTHER, INSULT, TARGETS, NEGATES, REPORTS, QUOTES, THREATENS, MENACED = range(8)  # MENACED: a target that a threat verb reaches
PLAIN, TARGETED, NEGATED, REPORTED = range(4)  # kinds of a match
CONTEXTS = ("target", "threat", "negation", "report", "quote")
MATCHES = (INSULT, THREATENS, MENACED)
_TOKEN = re.compile(r"\w+|[.!?;\n\"“”«»„]")
_BOUNDARY = frozenset(".!?;\n")
_QUOTE = frozenset("\"“”«»„")


class Transducer:
    """Deterministic: (state, symbol) -> (state, output symbol). Symbols without an arc pass and keep the state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        """This one's output is the other's input."""

        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols) -> tuple[list[dict], int]:
        """Arcs by state number, over all reachable states."""
        at, arcs, todo = {self.start: 0}, [], [self.start]
        while todo:
            state = todo.pop(0)
            row = {}
            for s in symbols:
                nxt, out = self.step(state, s)
                if nxt not in at:
                    at[nxt] = len(at)
                    todo.append(nxt)
                row[s] = (at[nxt], out)
            arcs.append(row)
        return arcs, 0


def _within(cue: int, kind: int, reach: int) -> Transducer:
    """A match (class, kind) that follows ``cue`` within ``reach`` tokens becomes ``kind``."""

    def step(left, symbol):
        cls, had = symbol
        if cls == cue:
            return reach, symbol
        out = (cls, kind) if left and cls in MATCHES else symbol
        return max(0, left - 1), out

    return Transducer(0, step)


def _after(cue: int, kind: int, toggles: bool) -> Transducer:
    """A match after ``cue`` in the clause (or between two cues) becomes ``kind``."""

    def step(on, symbol):
        cls, had = symbol
        if cls == cue:
            return (not on if toggles else True), symbol
        return on, ((cls, kind) if on and cls in MATCHES else symbol)

    return Transducer(False, step)


def _object(reach: int) -> Transducer:
    """The first target within ``reach`` tokens after a threat verb becomes a match of its own."""

    def step(left, symbol):
        cls, had = symbol
        if cls == THREATENS:
            return reach, symbol
        if left and cls == TARGETS:
            return 0, (MENACED, PLAIN)
        return max(0, left - 1), symbol

    return Transducer(0, step)


def _silent() -> Transducer:
    """Threat verbs are words like others."""
    return Transducer(0, lambda state, symbol: (state, (OTHER, PLAIN) if symbol[0] == THREATENS else symbol))


@lru_cache(maxsize=16)
def grammar(without: frozenset[str] = frozenset()) -> list[dict]:
    """Targets and threats, then negation, then reports and quotation: the last context that applies names the match.

    ``without``: contexts of ``CONTEXTS`` to leave out, to see what each of them does.
    """
    parts = [
        ("target", _within(TARGETS, TARGETED, 4)), ("threat", _object(2)), ("negation", _within(NEGATES, NEGATED, 4)),
        ("report", _after(REPORTS, REPORTED, False)), ("quote", _after(QUOTES, REPORTED, True)),
    ]
    machine = _silent() if "threat" in without else Transducer(0, lambda state, symbol: (state, symbol))
    for name, part in parts:
        if name not in without:
            machine = machine.compose(part)
    return machine.table([(c, PLAIN) for c in range(7)])[0]


@dataclass
class Model:
    """``stems``: stem -> (weight, weight without one toxic document, weight without one other)."""

    stems: dict[str, tuple[float, float, float]]
    beta: list[float]

    def to_json(self) -> str:
        return json.dumps({"stems": self.stems, "beta": self.beta})


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if k < len(word)] + [word + "$"]


def weight(pos: float, neg: float, p: float, n: float) -> float:
    """Log odds of the label given the stem, lowered by its standard error."""
    if pos <= 0:
        return 0.0
    w = math.log((pos + 0.5) / (p + 1)) - math.log((neg + 0.5) / (n + 1))
    return w - CAUTION * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) - 1 / (p + 1) - 1 / (n + 1))


#: Intercept; three largest stems; sums of all and of targeted matches; what negated and reported ones hold of the first (as
#: minus); bare and targeted threats; length; largest stem by length.
N_FEATURES = 12
#: What the regression believes of a feature before any label (others: 0), and the least it may come to.
PRIOR = {5: 0.5, 6: 0.5, 7: 0.5, 8: 0.5, 9: 2.0}
LEAST = {5: 0.1, 6: 0.1, 7: 0.1, 8: 0.1, 9: 0.2}


class Scorer:
    """Runs the lexicon and the grammar over texts."""

    def __init__(self, model: Model, without: frozenset[str] = frozenset()):
        self.model = model
        self.memo: dict[str, tuple] = {}
        self.arcs = grammar(without)

    def classify(self, word: str) -> tuple[int, tuple[float, float, float]]:
        if word in TARGET:
            c = TARGETS
        elif word in NEGATION:
            c = NEGATES
        elif word in REPORT:
            c = REPORTS
        else:
            c = THREATENS if word in THREAT else OTHER
            best = max((self.model.stems[s] for s in stems_of(word) if s in self.model.stems), default=None)
            if best is not None:
                return (INSULT if c == OTHER else c), best
        return c, (0.0, 0.0, 0.0)

    def features(self, text: str | None, label: int | None = None) -> list[float]:
        """``label``: that of a training row, whose own counts are then taken out of its stems' weights."""
        tokens = _TOKEN.findall((text or "").lower())
        memo = self.memo
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        for w in set(tokens).difference(memo):
            memo[w] = None if w in _BOUNDARY else (QUOTES, (0.0, 0.0, 0.0)) if w in _QUOTE else self.classify(w)
        which = 0 if label is None else 1 if label else 2
        found = [memo[w] for w in tokens]
        marked = [i for i, x in enumerate(found) if x is not None and (x[0] == INSULT or x[0] == THREATENS)]
        sums, threats = [0.0] * 4, [0.0] * 2
        top: dict[str, float] = {}
        done = -1
        for i in marked:
            if i <= done:
                continue
            a = i
            while a > 0 and found[a - 1] is not None:
                a -= 1
            b, state, verb = a, 0, 0.0
            while b < len(found) and found[b] is not None:
                cls, w = found[b]
                state, (out, kind) = self.arcs[state][(cls, PLAIN)]
                if out == THREATENS:
                    verb = THREAT[tokens[b]]
                if b >= i and out in MATCHES:
                    active = kind in (PLAIN, TARGETED)
                    if out == MENACED:
                        threats[1] += verb if active else 0.0
                    elif out == THREATENS and active:
                        threats[kind == TARGETED] += verb
                    x = max(0.0, w[which])
                    sums[kind] += x
                    if active and x > top.get(tokens[b], 0.0):
                        top[tokens[b]] = x
                b += 1
            done = b
        best = sorted(top.values(), reverse=True)[:3] + [0.0] * 3
        size = math.log1p(len(tokens))
        active = math.log1p(sums[PLAIN] + sums[TARGETED])
        denied = math.log1p(sums[PLAIN] + sums[TARGETED] + sums[NEGATED])
        whole = math.log1p(sum(sums))
        return [1.0, *best[:3], whole, math.log1p(sums[TARGETED]), active - denied, denied - whole, *map(math.log1p, threats), size / 10, best[0] * size / 10]

    def score(self, text: str | None) -> float:
        z = sum(b * f for b, f in zip(self.model.beta, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method, drawn to ``PRIOR``; the rarer label weighs more, by the root of its rarity.

    A coefficient that comes out under its ``LEAST`` is held there, and the others are fitted again.
    """
    prior = np.array([PRIOR.get(i, 0.0) for i in range(x.shape[1])])
    each = np.where(y > 0, math.sqrt((len(y) - y.sum()) / max(1.0, y.sum())), 1.0)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    beta, free = prior.copy(), np.ones(x.shape[1], dtype=bool)
    while True:
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = (x.T @ (each * (y - p)) - penalty * (beta - prior))[free]
            own = x[:, free]
            d = np.linalg.solve((own * (each * p * (1 - p))[:, None]).T @ own + np.diag(penalty[free]), g)
            beta[free] += d
            if np.abs(d).max() < 1e-8:
                break
        low = [i for i, least in LEAST.items() if free[i] and beta[i] < least]
        if not low:
            return beta
        for i in low:
            beta[i], free[i] = LEAST[i], False


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of labelled ids outside the held-out fold, a row for each id, materialized.

    An id with several labels counts by the largest, one with several rows by one of those with the smallest hash of the text.
    With more than ``FIT_ROWS`` such ids, those under the quantile of a hash that leaves as many. The labels are bounded before
    the join, so they are broadcast, and no text is shuffled but those of ids with several rows.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = materialize(own.where(_fold() != 1).groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    n = own.count()
    if n > FIT_ROWS:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int((1 << 31) * FIT_ROWS / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.join(F.broadcast(own), "doc_id").withColumn("h", F.xxhash64("text")), "train")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("least")).where("n > 1").select(F.col("doc_id").alias("again"), "least")
    several = materialize(several, "several")
    once = rows.join(several, rows["doc_id"] == several["again"], "left_anti").select("text", "label")
    first = rows.join(several, (rows["doc_id"] == several["again"]) & (rows["h"] == several["least"])).dropDuplicates(["doc_id"]).select("text", "label")
    return once if several.isEmpty() else materialize(once.unionByName(first), "train")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn stems and the regression from the bounded training rows.

    Without training rows of both labels the model scores everything by the share of toxic ones (none: 0).
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels)
    n, p = rows.agg(F.count("*"), F.sum("label")).first()
    p = p or 0
    if not p or p == n:
        share = (p + 0.5) / (n + 1) if n else 1e-9
        return Model({}, [math.log(share / (1 - share)), *[0.0] * (N_FEATURES - 1)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            pos, neg = zip(*held.values()) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], names=["stem", "pos", "neg"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0 if label else 1
                for s in {s for w in set(_TOKEN.findall((text or "").lower())) if len(w) > 1 for s in stems_of(w)}:
                    c = held.get(s)
                    if c is None:
                        c = held[s] = [0, 0]
                    c[at] += 1
            if len(held) > HELD_COUNTS:
                yield out()
                held.clear()
        yield out()

    bound_batches(spark)
    counts = rows.select("text", "label").mapInArrow(tidy(count), "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos"), F.col("neg")
    lcb = (
        F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n - p + 1)) - CAUTION * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) - 1 / (p + 1) - 1 / (n - p + 1))
    )
    chosen = counts.where(a >= MIN_SUPPORT).withColumn("w", lcb).where(F.col("w") > MIN_WEIGHT).collect()
    stems = {r["stem"]: (r["w"], weight(r["pos"] - 1, r["neg"], p - 1, n - p), weight(r["pos"], r["neg"] - 1, p, n - p - 1) if r["neg"] else r["w"]) for r in chosen}
    model = Model(stems, [])
    shipped = spark.sparkContext.broadcast(model)  # bounded by FIT_ROWS

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shipped.value)
        for b in batches:
            rows = [s.features(t, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    bound_batches(spark)
    table = rows.select("text", "label").mapInArrow(tidy(featurize), "x array<double>, y int").toArrow()
    y = table.column("y").to_numpy().astype(float)
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(len(y), N_FEATURES)
    model.beta = fit_logistic(x, y).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` ids and texts -> (doc_id, score double): one row for each row. Null texts count as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted. A null id is in no fold: ``held_out`` is null then."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (_fold() == 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text scores ``cut`` or more; columns as they were."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text = [f.name for f in docs.schema.fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shipped.value)
        for b in batches:
            yield b.filter(pa.array([s.score(t) < cut for t in b.column(text).to_pylist()], pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
