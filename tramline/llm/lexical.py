"""Ranked lexical search by block-max pruning.

The index is a table of blocks, each of consecutive documents: the block's terms with the largest impact and the document
count of each, and a forward index, which has for each document the positions of its terms in that list and their counts.
A search goes over the queries in blocks of bounded size. One pass over the terms' columns gives the documents a term is
in, and its largest block maxima; as blocks hold different documents, the k-th largest, weighed, is a score that k documents
reach, and so a floor for the query's result. A second pass bounds every query in every block by the maxima, takes a batch's blocks
in descending order of the bound, scores their forward index, and stops for a query where the bound is under its floor, which
rises with the k-th best score found so far. Scores are integers; nothing else decides who is ranked, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, tidy

#: Documents of a block. A block is also over when an Arrow batch is (see ``common``).
BLOCK_DOCS = 64
#: Bytes of query text that one search pass takes, and one query more.
QUERY_BYTES = 4 << 20
#: Blocks of a row group of the written index. Writers hold a row group and readers decode up to 4,096 rows of one at once; a block may
#: have a megabyte, so without this bound a task's memory grows with its share of the documents.
GROUP = {"parquet.block.row.count.limit": "16", "parquet.block.size": str(8 << 20)}
#: The scale of impacts, and the parameters of the length norm, in hundredths.
SCALE, SATURATION, FLAT, LENGTH = 1_000_000_000, 12, 75, 25

#: ASCII letters in lower case, ASCII digits, and every byte of other characters; all else separates terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_LIST = lambda t: T.ArrayType(t, False)
INDEX = T.StructType([
    T.StructField("terms", _LIST(T.BinaryType())), T.StructField("maxima", _LIST(T.LongType())), T.StructField("docs", _LIST(T.LongType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType(), True)), T.StructField("sizes", _LIST(T.IntegerType())), T.StructField("codes", _LIST(T.IntegerType())), T.StructField("impacts", _LIST(T.LongType())),
])


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, only A-Z lower-cased. Null has none."""
    return (text or "").encode().translate(_TABLE).split()


def norm(n, docs: int, terms: int):
    """A document of ``n`` terms among ``docs`` with ``terms`` in all."""
    return FLAT + (LENGTH * n * docs) // terms


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms): two sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                k = len(terms_of(text))
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]}, schema=pa.schema([("n", pa.int64()), ("total", pa.int64())]))

    row = docs.select("text").mapInArrow(tidy(count), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def _block(ids: list, docs: list[list[bytes]], n_docs: int, n_terms: int) -> dict:
    tokens = pa.array([t for d in docs for t in d], pa.binary()).dictionary_encode()
    width = len(tokens.dictionary)
    code = tokens.indices.to_numpy().astype(np.int64)
    lengths = np.array([len(d) for d in docs], np.int64)
    key, tf = np.unique(np.repeat(np.arange(len(docs)), lengths) * width + code, return_counts=True)
    doc, code = key // width, key % width
    impacts = (SCALE * tf) // (1000 * tf + SATURATION * norm(lengths, n_docs, n_terms)[doc])
    maxima = np.zeros(width, np.int64)
    np.maximum.at(maxima, code, impacts)
    return {"terms": tokens.dictionary.to_pylist(), "maxima": maxima, "docs": np.bincount(code, minlength=width), "doc_ids": ids, "sizes": np.bincount(doc, minlength=len(docs)).astype(np.int32), "codes": code.astype(np.int32), "impacts": impacts}


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row a block of up to BLOCK_DOCS consecutive documents with a term. Map only: a document is read, and not moved."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("terms", pa.list_(pa.binary())), ("maxima", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if found := terms_of(text):
                    ids.append(i)
                    held.append(found)
                    if len(ids) == BLOCK_DOCS:
                        yield pa.RecordBatch.from_pylist([_block(ids, held, n_docs, n_terms)], schema)
                        ids, held = [], []
            if ids:
                yield pa.RecordBatch.from_pylist([_block(ids, held, n_docs, n_terms)], schema)
                ids, held = [], []

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(build), INDEX)


def written_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    return materialize(build_index(docs, n_docs, n_terms), "lexical", **GROUP)


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Distinct (item_id, text) with a term, in lists of QUERY_BYTES and one more at most: read partition by partition."""
    held, size = [], 0
    for row in queries.select("item_id", "text").distinct().toLocalIterator():
        if found := Counter(terms_of(row["text"])):
            held.append((row["item_id"], found))
            size += len(row["text"])
            if size >= QUERY_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _term_statistics(index: DataFrame, vocabulary, k: int) -> dict[int, tuple[int, list[int]]]:
    """For each term of the broadcast ``vocabulary``: (documents that hold it, its k largest block maxima, largest first)."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64()), ("top", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary.value, pa.binary())
        n, best = np.zeros(len(words), np.int64), np.zeros((len(words), k), np.int64)
        for b in batches:
            at = pc.index_in(b.column(0).flatten(), value_set=words)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            t = at.drop_null().to_numpy()
            np.add.at(n, t, b.column(2).flatten().to_numpy()[known])
            top = b.column(1).flatten().to_numpy()[known]
            for begin in range(0, len(t), len(words)):  # a few values a term at a time: rank them within their term
                part, value = t[begin : begin + len(words)], top[begin : begin + len(words)]
                order = np.lexsort((-value, part))
                part, value = part[order], value[order]
                rank = np.arange(len(part)) - np.searchsorted(part, part)
                keep = rank < k
                wide = np.zeros((len(words), k), np.int64)
                wide[part[keep], rank[keep]] = value[keep]
                touched = np.unique(part)
                best[touched] = -np.sort(-np.concatenate([best[touched], wide[touched]], axis=1), axis=1)[:, :k]
        seen = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array([x[x > 0] for x in best[seen]], pa.list_(pa.int64()))], schema=schema)

    parts = index.select("terms", "maxima", "docs").mapInArrow(tidy(count), "term int, n long, top array<long>")
    sums = parts.groupBy("term").agg(F.sum("n").alias("n"))
    ranked = parts.select("term", F.explode("top").alias("v")).withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("v")))).where(F.col("r") <= k)
    tops = ranked.groupBy("term").agg(F.sort_array(F.collect_list("v"), False).alias("top"))
    return {r["term"]: (r["n"], list(r["top"])) for r in sums.join(tops, "term").collect()}


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class _Best:
    """The k best (score, doc_id) of one query so far; ``floor`` is a score that k documents reach."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.scores, self.ids, self.held = [], [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= max(self.floor, 1)
        if keep.any():
            self.scores.append(scores[keep])
            self.ids.append(ids[keep])
            self.held += int(keep.sum())
            if self.held >= 4 * self.k:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores, ids = np.concatenate(self.scores), np.concatenate(self.ids)
        order = np.lexsort((ids, -scores))[: self.k]
        scores, ids = scores[order], ids[order]
        if len(scores) == self.k:
            self.floor = max(self.floor, int(scores[-1]))
        self.scores, self.ids, self.held = [scores], [ids], len(scores)
        return scores, ids


#: Stands for a null id among integers; ranked after all others.
_NO_ID = np.iinfo(np.int64).max


def _scored(index: DataFrame, shared, k: int) -> DataFrame:
    """(query, doc_id, score): for each query the k best documents of every task."""
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, starts, query_of, weight_of, floors = shared.value
        words = pa.array(words, pa.binary())
        best = [_Best(k, f) for f in floors]
        for batch in batches:
            blocks, bounds = [], []
            for i in range(batch.num_rows):
                at = pc.index_in(batch.column(0)[i].values, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
                known = np.nonzero(at >= 0)[0]
                t = at[known]
                many = starts[t + 1] - starts[t]
                cell = np.repeat(starts[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())  # all (query, weight) cells of the block's terms
                top = batch.column(1)[i].values.to_numpy()[known]
                bound = np.zeros(len(floors), np.int64)
                np.add.at(bound, query_of[cell], weight_of[cell] * np.repeat(top, many))
                blocks.append((known, many, cell))
                bounds.append(bound)
            if not bounds:
                continue
            bounds = np.stack(bounds)
            ready: dict[int, tuple] = {}
            for q in np.nonzero((bounds >= np.maximum(floors, 1)).any(axis=0))[0]:
                mine = best[q]
                for i in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[i, q] < max(mine.floor, 1):
                        break
                    if i not in ready:
                        known, many, cell = blocks[i]
                        codes = batch.column(5)[i].values.to_numpy()
                        width = len(batch.column(0)[i].values)
                        sizes = batch.column(4)[i].values.to_numpy()
                        slot = np.repeat(known, many)
                        order = np.argsort(query_of[cell], kind="stable")
                        ids = batch.column(3)[i].values.fill_null(_NO_ID).to_numpy()
                        hit = np.zeros(width, bool)
                        hit[known] = True
                        use = hit[codes]
                        ready[i] = (codes[use], batch.column(6)[i].values.to_numpy()[use], np.repeat(np.arange(len(sizes)), sizes)[use], ids, width, slot[order], query_of[cell][order], weight_of[cell][order])
                    codes, impacts, doc, ids, width, slot, owner, weights = ready[i]
                    lo, hi = np.searchsorted(owner, [q, q + 1])
                    w = np.zeros(width, np.int64)
                    w[slot[lo:hi]] = weights[lo:hi]
                    gain = w[codes]
                    has = np.nonzero(gain)[0]
                    scores = np.zeros(len(ids), np.int64)
                    np.add.at(scores, doc[has], gain[has] * impacts[has])
                    mine.add(scores, ids)
        for q, mine in enumerate(best):
            scores, ids = mine.cut()
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], schema=schema)

    return index.mapInArrow(tidy(search), "query int, doc_id long, score long")


def _search_block(spark: SparkSession, index: DataFrame, queries: list[tuple], n_docs: int, k: int) -> DataFrame:
    words = sorted({t for _, found in queries for t in found})
    number = {t: i for i, t in enumerate(words)}
    stats = _term_statistics(index, spark.sparkContext.broadcast(words), k)
    weights = {i: weight(n_docs, df) for i, (df, _) in stats.items()}
    cells, floors = [], []
    for q, (_, found) in enumerate(queries):
        floor = 0
        for t, times in found.items():
            if (i := number[t]) in weights:
                cells.append((i, q, times * weights[i]))
                top = stats[i][1]
                floor = max(floor, times * weights[i] * top[k - 1] if len(top) == k else 0)
        floors.append(floor)
    cells.sort()
    table = np.array(cells, np.int64).reshape(-1, 3)
    starts = np.searchsorted(table[:, 0], np.arange(len(words) + 1))
    found = _scored(index, spark.sparkContext.broadcast((words, starts, table[:, 1], table[:, 2], np.array(floors, np.int64))), k)
    items = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", _type_of(queries))]))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(items, "query").select("item_id", "rank", "doc_id", "score")


def _type_of(queries: list[tuple]) -> T.DataType:
    return T.StringType() if any(isinstance(i, str) for i, _ in queries) else T.LongType()


def search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of ``queries`` (item_id, text) its k best of ``docs`` (doc_id, text).

    Every document is indexed and may be found. Items without a term that a document holds give no rows, as do null and empty
    texts; an item row that occurs twice counts once, and rows that share an id but not the text are ranked each by itself.
    Documents of equal ids are documents of their own; a null id is ranked after others of its score. Ties go by ascending id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n_docs, n_terms = corpus_size(docs)
    found = None
    if n_docs:
        index = written_index(docs, n_docs, n_terms)
        for block in _query_blocks(queries):
            part = _search_block(spark, index, block, n_docs, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], T.StructType([queries.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return found.select(F.col("item_id").cast(queries.schema["item_id"].dataType), "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same rows by scoring every document that holds a term of the item.
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
posting AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT DISTINCT item_id, text FROM benchmark), unnest({_TERMS.format("text")}) u(term) GROUP BY ALL),
scored AS (SELECT item_id, text, r, doc_id,
    CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
      * (({SCALE}::BIGINT * tf) // (1000 * tf + {SATURATION} * ({FLAT} + ({LENGTH} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN posting USING (term), corpus GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
