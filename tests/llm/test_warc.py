import gzip
import json
import zlib

from tramline.llm import warc
from tramline.llm.common import fresh_path

PAGE = '<html><head><title>A &amp; B</title><meta charset="utf-8"></head><body><nav>menu</nav><p>Hällo <a href="/x?a=1&amp;b=2">link</a></p><script>no</script></body></html>'


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, record string, block string")


def test_round_trip_of_records():
    raw = warc.response(1, "http://a.test/", PAGE) + warc.response(2, "http://b.test/", "")
    (a, block), (b, _) = warc.parse(raw)
    assert warc.get(a, "WARC-Type") == "response" and warc.get(b, "warc-target-uri") == "http://b.test/"
    assert int(warc.get(a, "Content-Length")) == len(block)
    assert warc.get(a, "WARC-Payload-Digest") == warc.sha1(PAGE.encode())
    assert warc.sha1(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_derivatives_link_and_preserve(spark):
    rows = [(1, "http://a.test/", PAGE), (2, None, None), (None, "http://c.test/", "<p>x"), (1, "http://a.test/", PAGE), (5, "http://d.test/\r\nX: y", "w " * 50_000)]
    out = warc.derivatives(warc.responses(frame(spark, rows))).collect()
    assert len(out) == 2 * len(rows)
    fields, _ = next(warc.parse(warc.response(1, "http://a.test/", PAGE)))
    meta = next(r for r in out if r["page_id"] == 1 and r["record_type"] == "metadata")
    text = next(r for r in out if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert meta["refers_to"] == text["refers_to"] == warc.get(fields, "WARC-Record-ID")
    assert meta["concurrent_to"] == text["record_id"] and meta["target_uri"] == text["target_uri"] == "http://a.test/"
    assert meta["source_digest"] == warc.sha1(PAGE.encode())
    assert text["block"] == "menu\nHällo link" and text["block_digest"] == warc.sha1(text["block"].encode())
    envelope = json.loads(meta["block"])
    assert envelope["source"]["warc_headers"] == [list(f) for f in fields] and envelope["source"]["http_status"] == 200
    assert envelope["html"]["title"] == "A & B" and envelope["html"]["links"] == [{"element": "a", "url": "/x?a=1&b=2"}]
    assert envelope["payload"]["digest_matches"] and envelope["conversion"]["record_id"] == text["record_id"]
    assert all(r["content_length"] == len(r["block"].encode()) for r in out)
    assert warc.derivatives(warc.responses(frame(spark, []))).collect() == []


def test_other_records_and_bad_digests():
    fields = [("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:1>")]
    assert warc.derive(fields, b"GET / HTTP/1.1\r\n\r\n") == []
    (_, _, meta), (_, head, text) = warc.derive([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9")
    assert json.loads(meta)["payload"]["digest_matches"] is False and json.loads(meta)["source"]["http_status"] == 404
    assert text.decode() == "é" and ("WARC-Refers-To", "<urn:x>") in head and ("WARC-Date", warc.DATE) in head
    for bad in (b"nonsense", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.1\r\nContent"):
        try:
            list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def payload_of(headers, body):
    return warc.split_http("\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + body)[3]


def test_codings():
    text = b"<p>" + b"some text " * 200
    chunked = b"".join(b"%x;a=b\r\n%s\r\n" % (len(text[i : i + 333]), text[i : i + 333]) for i in range(0, len(text), 333)) + b"0\r\nX: y\r\n\r\n"
    assert payload_of(["Transfer-Encoding: chunked"], chunked) == text
    assert payload_of(["transfer-encoding: Chunked", "Content-Encoding: gzip"], b"5\r\n" + gzip.compress(text)[:5] + b"\r\n%x\r\n" % (len(gzip.compress(text)) - 5) + gzip.compress(text)[5:] + b"\r\n0\r\n\r\n") == text
    assert payload_of(["Content-Encoding: gzip"], gzip.compress(text[:9]) + gzip.compress(text[9:])) == text
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(text) + raw.flush()
    assert payload_of(["Content-Encoding: deflate"], zlib.compress(text)) == payload_of(["Content-Encoding: deflate"], raw) == text
    assert payload_of(["Content-Encoding: gzip, deflate"], zlib.compress(gzip.compress(text))) == text
    assert payload_of(["Content-Encoding: br"], b"\x0b\x00x") == b"\x0b\x00x"
    damaged = gzip.compress(text)[:10] + b"\xff" * 30
    assert payload_of(["Content-Encoding: gzip"], damaged) == damaged
    assert text.startswith(payload_of(["Content-Encoding: gzip"], gzip.compress(text)[:-12]))
    assert payload_of(["Transfer-Encoding: chunked"], b"zz\r\nrest") == b"zz\r\nrest"
    for charset in ("undefined", "idna", "no-such", "hex", "punycode"):
        assert warc.decode_payload("aé".encode(), [("Content-Type", f"text/html; charset={charset}")])


def test_repeated_headers_stay_and_damage_stays_with_its_record(spark):
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    whole = warc.build(fields, b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n<p>x")
    (_, _, meta), _ = warc.derive(*next(warc.parse(whole)))
    source = json.loads(meta)["source"]
    assert [v for k, v in source["warc_headers"] if k == "WARC-Concurrent-To"] == ["<urn:a>", "<urn:b>"] and len(source["http_headers"]) == 2
    damaged = [b"nonsense", b"WARC/1.1\r\nContent-Length: -3\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", whole[:-9], gzip.compress(whole)[:-12], gzip.compress(b"junk") + gzip.compress(whole)]
    rows = [(i, raw) for i, raw in enumerate([*damaged, whole, None])]
    got = {}
    for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect():
        got.setdefault(r["page_id"], []).append(r["record_type"])
    assert got == {**{i: ["damaged"] for i in range(6)}, 6: ["damaged", "metadata", "conversion"], 7: ["metadata", "conversion"]}


def test_files(spark):
    rows = [(i, f"http://a.test/{i}", f"<p>{i}") for i in range(20)]
    records = warc.responses(frame(spark, rows))
    to = fresh_path(spark, "w")
    assert sum(r["records"] for r in warc.write_files(records, to).collect()) == 20
    back = {bytes(r["record"]) for r in warc.read_files(spark, to).collect()}
    assert back == {bytes(r["record"]) for r in records.collect()}
