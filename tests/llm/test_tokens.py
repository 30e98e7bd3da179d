import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tramline.llm import bpe, token_files
from tramline.llm.common import fresh_path

from .cases import ODD, documents

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
words = Tokenizer.from_file(WORDS)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_codec_equals_library(text):
    c = bpe.codec(RANKS, P.PATTERN)
    assert c.encode(text) == reference.encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))
    c = bpe.codec(RANKS, P.PATTERN)
    assert all(c.lookup(t) == i for i, t in c.tokens.items()) and c.lookup(b"no such token at all") is None


def test_round_trip_rows(spark):
    got = sorted((tuple(r) for r in bpe.round_trip(documents(spark), RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode(documents(spark), RANKS, P.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, RANKS, P.PATTERN).collect() if r["doc_id"]}
    assert all(back[i] == (t or "") for i, t in ODD if i)
    assert bpe.round_trip(documents(spark, []), RANKS, P.PATTERN).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(lengths):
    ends = np.cumsum(np.array(lengths, dtype=np.uint64))
    ef = token_files.EliasFano.build(ends)
    assert [ef.select(i) for i in range(len(ends))] == ends.tolist() == ef.values().tolist()
    if len(ends) > 64:
        u = int(ends[-1]) or 1
        assert ef.bits() <= len(ends) * (3 + max(0, np.log2(u / len(ends)))) + 512


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_word_encoder_equals_library(texts):
    e = token_files.encoder(WORDS)
    assert [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)] == [words.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_knows_the_library_s_added_tokens():
    added = [t.content for t in words.get_added_tokens_decoder().values()]
    assert added
    texts = [f(t) for t in added for f in (str, "a {} b".format, "a{}b".format, "{0}{0} x".format, "É{}! end".format, lambda t: t.upper(), lambda t: f"{t[:-1]} {t}", lambda t: f"\0{t}")]
    e = token_files.encoder(WORDS)
    got = [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)]
    assert got == [words.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[1] == [320, 49406, 321]


def test_ids_of_any_value_and_one_id_for_all(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(least, "a"), (most, "b"), (None, "c"), (0, None)]
    got = sorted(token_files.digests(documents(spark, rows), WORDS).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, least, 0, most]
    hot = documents(spark, [(7, f"t{i % 3}") for i in range(400)]).repartition(8)
    to = fresh_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_files.write_files(hot, to, WORDS, 1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.agg({"documents": "sum"}).first()[0] == 400 and files.count() > 1


def test_token_files(spark, monkeypatch):
    want, start = [], 0
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    for i, t in order:
        ids = [*words.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    got = sorted(token_files.digests(documents(spark), WORDS).collect(), key=lambda r: r["start"])
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert token_files.digests(documents(spark, []), WORDS).collect() == []


def test_files_hold_documents(spark):
    to = fresh_path(spark, "t")
    token_files.write_files(documents(spark), to, WORDS, 1)
    got = {r["doc_id"]: r["ids"] for r in token_files.read_files(spark, to).collect()}
    assert got[6] == [*words.encode("a b c d e f g", add_special_tokens=False).ids, 1]


def test_word_encoder_cuts_and_lowers_as_the_library():
    e = token_files.encoder(WORDS)
    letters = "".join(map(chr, range(0x21, 0x250)))
    odd = ["\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ", " a\tb\x0bC\x0cd\re\n\nf ", "\x1cA\x1d b\x85c", "x\xa0y z w", "w" * 65, ("Ab" * 40 + "! ") * 3, "</w> a</w> a</ </", " ", ""]
    texts = [*odd, *letters, *(f"{c}x{c}," for c in letters), *(f"a{c}" for c in letters), " ".join(letters), None]
    column = pa.array(texts, pa.string())
    want = [words.encode(t or "", add_special_tokens=False).ids for t in texts]
    for c in (column, column.cast(pa.large_string()), pa.concat_arrays([pa.array(["cut off"]), column, pa.array(["too"])]).slice(1, len(texts))):
        ids, lengths = e.encode_column(c)
        assert [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])] == want
    for none in ([], [None, ""]):
        ids, lengths = e.encode_column(pa.array(none, pa.string()))
        assert len(ids) == 0 and lengths.tolist() == [0] * len(none)


def test_word_encoder_learns_once_and_keeps_what_is_used(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_LIMIT", 60)
    learned = []
    learn = token_files.WordEncoder._learn_parts
    monkeypatch.setattr(token_files.WordEncoder, "_learn_parts", lambda self, parts: learned.extend(parts) or learn(self, parts))
    e = token_files.WordEncoder(WORDS)
    for batch in range(12):
        rare = [f"rare{'abcdefghijkl'[batch]}{'abcdefghijklmnopqrst'[i]}" for i in range(20)]
        texts = ["Common words, Common, common!", " ".join(rare), "4.0 words " * 50]
        assert [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)] == [words.encode(t, add_special_tokens=False).ids for t in texts]
    assert [learned.count(w) for w in (b"common", b"words", b",", b"!")] == [1, 1, 1, 1]
    assert len(learned) == 12 * 20 + 4 and len(e.memory.used) <= 60 + 25


def test_files_close_within_a_batch(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 100)
    rows = [(i, "a b c " * (i % 40)) for i in range(300)]
    to = fresh_path(spark, "t")
    token_files.write_files(documents(spark, rows).coalesce(1), to, WORDS, 1)
    got = token_files.read_files(spark, to).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*words.encode(t, add_special_tokens=False).ids, 1] for i, t in rows} and len(got) == 300
    files = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        files.setdefault((r["part"], r["file"]), []).append(len(r["ids"]))
    last = {max(f for f in files if f[0] == part) for part, _ in files}
    assert all(sum(n[:-1]) < 100 <= sum(n) for f, n in files.items() if f not in last)  # the document that reaches the bound closes
    assert len(files) > 50
