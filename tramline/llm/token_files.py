"""Token-id output: concatenated id arrays in files, with Elias-Fano document boundaries.

File layout, all little-endian::

    "TLTK" u32 version | u64 documents n | u64 ids | u32 bytes an id | u32 first documents without an id | u32 low bits l
    u32 words of the low part | u32 words of the high part | u32 select samples | u32 bytes of the document ids
    low part: n * l bits in u64 words | high part: u64 words | samples: u32 place of every 256th set bit
    document ids: i64 deltas, zlib | ids: u16 if all of the file's are below 65536, else u32

The boundaries (ends of documents in the id array) are a non-decreasing sequence of n numbers up to u: l = floor(log2(u/n))
low bits of each are stored as they are, the rest in unary as set bits; n*(2 + log2(u/n)) bits in all. ``select`` goes on
from a sampled set bit by popcounts, so that no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, materialize, put_file, tidy

MAGIC, VERSION, SAMPLE = b"TLTK", 2, 256
FILE_IDS = 2_000_000  # a file is closed at so many ids, so that one fits in memory and in a row
MEMO_LIMIT = 800_000
MEMO_BYTES = 64  # longer chunks are forgotten after a batch
CALL = 128  # chunks in one string: the library takes longer for each in long ones
STEP = 1 << 16  # pieces that are put together at once


class EliasFano:
    """A non-decreasing sequence of non-negative integers with select and O(n) bits over the minimum."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        u = int(v[-1])
        l = max(0, (max(u, 1) // n).bit_length() - 1)
        low = np.zeros((n * l + 63) // 64 + 1, dtype=np.uint64)
        if l:
            part = v & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = (off + np.uint64(l)) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        return cls(n, l, low, high, ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        if not self.l:
            return 0
        at = i * self.l
        word, off = at >> 6, at & 63
        x = int(self.low[word]) >> off
        if off + self.l > 64:
            x |= int(self.low[word + 1]) << (64 - off)
        return x & ((1 << self.l) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits to pass, from the sampled one on
        word = place >> 6
        x = int(self.high[word]) >> (place & 63) << (place & 63)
        while (c := x.bit_count()) <= left:
            left -= c
            word += 1
            x = int(self.high[word])
        for _ in range(left):
            x &= x - 1
        at = word * 64 + (x & -x).bit_length() - 1
        return (at - i) << self.l | self._low(i)

    def values(self) -> np.ndarray:
        """All values in order."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        high = np.nonzero(bits)[0][: self.n] - np.arange(self.n)
        if not self.l:
            return high.astype(np.int64)
        at = np.arange(self.n, dtype=np.uint64) * np.uint64(self.l)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> off
        over = (off + np.uint64(self.l)) > 64
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return (high.astype(np.int64) << self.l) | (x & np.uint64((1 << self.l) - 1)).astype(np.int64)

    def bits(self) -> int:
        return 64 * (len(self.low) + len(self.high)) + 32 * len(self.samples)


HEAD = struct.Struct("<4sIQQIIIIIII")


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes. Documents without an id come first."""
    ef = EliasFano.build(np.cumsum(lengths, dtype=np.uint64))
    nulls = sum(k is None for k in doc_ids)
    known = np.array(doc_ids[nulls:], dtype="<i8")
    with np.errstate(over="ignore"):
        keys = zlib.compress(np.diff(known, prepend=np.int64(0)).astype("<i8").tobytes(), 1)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = HEAD.pack(MAGIC, VERSION, len(lengths), len(ids), width, nulls, ef.l, len(ef.low), len(ef.high), len(ef.samples), len(keys))
    return b"".join([head, ef.low.astype("<u8").tobytes(), ef.high.astype("<u8").tobytes(), ef.samples.astype("<u4").tobytes(), keys, ids.astype(f"<u{width}").tobytes()])


class TokenFile:
    """Reads a packed file; documents by their place in it."""

    def __init__(self, raw: bytes):
        magic, version, n, total, width, nulls, l, low, high, samples, keys = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = HEAD.size
        parts = []
        for kind, k in (("<u8", low), ("<u8", high), ("<u4", samples)):
            parts.append(np.frombuffer(raw, dtype=kind, count=k, offset=at))
            at += parts[-1].nbytes
        self.ends = EliasFano(n, l, *parts)
        with np.errstate(over="ignore"):
            known = np.cumsum(np.frombuffer(zlib.decompress(raw[at : at + keys]), dtype="<i8"))
        self.doc_ids = [None] * nulls + known.tolist()
        self.ids = np.frombuffer(raw, dtype=f"<u{width}", count=total, offset=at + keys)

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def spans(self) -> list[tuple[int, int]]:
        """All documents' places, decoded in one pass over the boundaries."""
        ends = self.ends.values().tolist()
        return list(zip([0, *ends], ends))

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b]


def gather(ids: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The runs ``ids[ends[k] : ends[k + 1]]`` for all k of ``numbers``, one after the other."""
    out = [ids[:0]]
    for at in range(0, len(numbers), STEP):
        begin, end = ends[numbers[at : at + STEP]], ends[numbers[at : at + STEP] + 1]
        stop = np.cumsum(end - begin)
        out.append(ids[np.repeat(end - stop, end - begin) + np.arange(stop[-1])])
    return np.concatenate(out)


class Memory:
    """The ids of remembered pieces of text by their numbers; piece 0 is empty."""

    def __init__(self, dtype: np.dtype):
        self.numbers: dict[bytes, int] = {b"": 0}
        self.ids = np.zeros(0, dtype)
        self.ends = np.zeros(2, np.int64)
        self.used = np.zeros(1, np.int64)
        self.now = 0

    def find(self, pieces: list[bytes] | np.ndarray, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of different pieces. What isn't remembered is learned: ``learn`` returns lengths and ids."""
        found = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.nonzero(found < 0)[0]
        if len(at):
            new = [pieces[i] for i in at.tolist()]
            lengths, ids = learn(new)
            found[at] = np.arange(len(self.used), len(self.used) + len(at))
            self.numbers.update(zip(new, found[at].tolist()))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.used = np.concatenate([self.used, np.zeros(len(at), np.int64)])
        self.used[found] = self.now
        return found

    def pass_batch(self, limit: int) -> None:
        """Count the next batch; of more than ``limit`` pieces, forget the half that wasn't used for longest, or more."""
        self.now += 1
        if len(self.used) <= limit:
            return
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        keep[0] = True
        keep = np.nonzero(keep)[0]
        pieces = list(self.numbers)
        self.numbers = {pieces[k]: i for i, k in enumerate(keep.tolist())}
        self.ids, lengths = gather(self.ids, self.ends, keep), np.diff(self.ends)[keep]
        self.ends, self.used = np.concatenate([[0], np.cumsum(lengths)]), self.used[keep]


class WordEncoder:
    """The tokenizers library behind a memory of pieces of white-space separated chunks.

    Its normalizer and splitter never join characters over ASCII white space, so a text's ids are those of its chunks in
    turn; a batch's different chunks are looked up once. Latin words with at most punctuation after them have two pre-tokens
    that need no normalizing but lower case, so the library's model is asked for these, with spaces between them: a pre-token's
    last token is one that ends a word. The other chunks are encoded by the whole library in one call, with a mark between
    them: a zero byte that stands alone is a token of its own. Chunks with a zero byte in them are encoded one by one.
    """

    MARK = "\0"
    PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ſ]+)(?P<after>[!-&(-/:-@\\[-`{-~]*)$"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.memory = Memory(self.dtype)
        model = self.tokenizer.model
        if not model.end_of_word_suffix:
            raise ValueError("the tokenizer's model doesn't mark ends of words")
        self.words = Tokenizer(model)
        self.words.pre_tokenizer = WhitespaceSplit()
        vocab = self.words.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for t, i in vocab.items() if t.endswith(model.end_of_word_suffix)]] = True
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[others] = 256 + np.arange(len(others))
        self.alphabet[32] = 32  # it stands between pre-tokens

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and ids of pre-tokens."""
        joined = [b" ".join(parts[at : at + CALL]) for at in range(0, len(parts), CALL)]
        shown = [self.alphabet[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le") for raw in joined]
        ids = np.concatenate([np.array(found.ids, dtype=self.dtype) for found in self.words.encode_batch_fast(shown, add_special_tokens=False)])
        ends = np.nonzero(self.closing[ids])[0] + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            raise ValueError("pre-tokens were joined or cut")
        return np.diff(ends, prepend=0), ids

    def _learn_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and ids of chunks of any kind."""
        found: list[np.ndarray] = [None] * len(chunks)
        marked = [i for i, w in enumerate(chunks) if self.mark is not None and b"\0" not in w]
        for i in set(range(len(chunks))).difference(marked):
            found[i] = np.array(self._ids(chunks[i].decode()), dtype=self.dtype)
        parts = [marked[at : at + CALL] for at in range(0, len(marked), CALL)]
        joined = [f" {self.MARK} ".encode().join([chunks[i] for i in part]).decode() for part in parts]
        for part, encoded in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype=self.dtype)
            cuts = np.nonzero(ids == self.mark)[0].tolist()
            if len(cuts) != len(part) - 1:
                raise ValueError("marks were joined with chunks")
            for i, begin, end in zip(part, [-1, *cuts], [*cuts, len(ids)]):
                found[i] = ids[begin + 1 : end]
        return np.array([len(ids) for ids in found], np.int64), np.concatenate([np.zeros(0, self.dtype), *found])

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has. A null has none."""
        memory = self.memory
        memory.pass_batch(MEMO_LIMIT)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        numbers = np.zeros((len(chunks), 2), np.int64)  # of a chunk's word and what is after it, or of the chunk
        short = pc.less_equal(pc.binary_length(chunks), MEMO_BYTES).to_numpy(zero_copy_only=False)
        cut = pc.extract_regex(chunks, self.PLAIN)
        plain = short & cut.is_valid().to_numpy(zero_copy_only=False)
        cut = cut.filter(pa.array(plain))
        parts = pa.concat_arrays([pc.utf8_lower(pc.struct_field(cut, "word")), pc.struct_field(cut, "after")]).dictionary_encode()
        found = memory.find(_pieces(parts.dictionary), self._learn_parts)[parts.indices.to_numpy()]
        numbers[plain] = found.reshape(2, -1).T
        other = [b" " + w for w in _pieces(chunks.filter(pa.array(short & ~plain)))]  # no part starts with a space
        numbers[short & ~plain, 0] = memory.find(other, lambda new: self._learn_chunks([w[1:] for w in new]))
        ids, ends = memory.ids, memory.ends
        if not short.all():  # these are forgotten after the batch
            lengths, more = self._learn_chunks(_pieces(chunks.filter(pa.array(~short))).tolist())
            numbers[~short, 0] = len(ends) - 1 + np.arange(len(lengths))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(lengths)])
        places = coded.indices.to_numpy()
        sizes = np.diff(ends)[numbers].sum(axis=1)
        out = gather(gather(ids, ends, numbers.ravel()), np.concatenate([[0], np.cumsum(sizes)]), places)
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy())])
        return out, np.diff(np.concatenate([[0], np.cumsum(sizes[places])])[words])

    def encode(self, texts: list[str | bytes | None]) -> list[bytes]:
        """Each text's ids as bytes of ``dtype``; UTF-8 if bytes."""
        ids, lengths = self.encode_column(pa.array([t.decode() if isinstance(t, bytes) else t for t in texts], pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


def _pieces(strings: pa.StringArray) -> np.ndarray:
    return strings.cast(pa.binary()).to_numpy(zero_copy_only=False)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_files(docs: DataFrame, to: str, path: str, end_id: int) -> DataFrame:
    """Encode all texts and write their ids, ``end_id`` after each document, as files under ``to`` in ascending id order.

    Null ids come first; ties go by the text's CRC. Null texts count as empty and have the end id only. Rows
    repeat as they do. An empty table writes no file. The rows are range-partitioned by id, then by what else orders them and
    the part of the input that they come from, so that a part is a range of ids, and rows of one id spread; a part is closed into several files as it streams. Returns the manifest, materialized: (part, file, documents,
    ids, first), one row a file, where ``first`` counts the ids of all files before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        e = encoder(path)
        file, keys, rows, lengths, held = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            put_file(to, f"{part:06d}-{file:06d}.tok", pack(keys, np.concatenate(lengths), np.concatenate(rows)))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64())], names=["part", "file", "documents", "ids"]
            )

        for b in batches:
            ids, own = e.encode_column(b.column(1))
            ids, own = np.insert(ids, np.cumsum(own), end_id), own + 1
            ends = np.concatenate([[0], np.cumsum(own)])
            at = 0
            while at < len(own):
                upto = min(int(np.searchsorted(ends, ends[at] + FILE_IDS - held)), len(own))
                keys += b.column(0)[at:upto].to_pylist()
                rows.append(ids[ends[at] : ends[upto]])
                lengths.append(own[at:upto])
                held += int(ends[upto] - ends[at])
                at = upto
                if held >= FILE_IDS:
                    yield close()
                    file, keys, rows, lengths, held = file + 1, [], [], [], 0
        if keys:
            yield close()

    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32("text").alias("crc"), F.spark_partition_id().alias("came"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("came")]
    files = materialize(own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(tidy(run), "part int, file int, documents long, ids long"), "files")
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("file")) - F.col("ids")
    return materialize(files.withColumn("inside", inside).join(before, "part").select("part", "file", "documents", "ids", (F.col("before") + F.col("inside")).alias("first")), "manifest")


def read_files(spark: SparkSession, at: str) -> DataFrame:
    """(part, file, doc_id, begin, ids array<int>): every document of the files under ``at``; ``begin`` counts from the file's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, file, t in _opened(batches):
            spans = t.spans()
            yield _rows(part, file, t, pa.array([a for a, _ in spans], pa.int64()), pa.array([t.ids[a:b] for a, b in spans], pa.list_(pa.int32())), names=["begin", "ids"])

    return _files(spark, at).mapInArrow(tidy(run), "part int, file int, doc_id long, begin long, ids array<int>")


def _files(spark: SparkSession, at: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(at).select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, TokenFile]]:
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
            part, file = path.rsplit("/", 1)[1].removesuffix(".tok").split("-")
            yield int(part), int(file), TokenFile(raw.as_buffer().to_pybytes())


def _rows(part: int, file: int, t: TokenFile, *columns: pa.Array, names: list[str]) -> pa.RecordBatch:
    n = len(t)
    keys = pa.array(t.doc_ids, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, file, np.int32)), keys, *columns], names=["part", "file", "doc_id", *names])


def digests(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """The contract's rows: the texts are written as files, and the files are read back by their boundaries."""
    spark = docs.sparkSession
    to = fresh_path(spark, "token-files")
    manifest = write_files(docs, to, path, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, file, t in _opened(batches):
            spans = t.spans()
            crc = [zlib.crc32(t.ids[a:b].astype("<u4").tobytes()) for a, b in spans]
            yield _rows(part, file, t, pa.array([a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(crc, pa.int64()), names=["begin", "n_tokens", "ids_crc32"])

    read = _files(spark, to).mapInArrow(tidy(run), "part int, file int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    first = manifest.select("part", "file", "first")
    return read.join(first, ["part", "file"]).select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
