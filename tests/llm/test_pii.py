import collections
import hashlib
import math
import random
import re

import duckdb

from tramline.llm import pii

from .cases import ODD, documents

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


EDGE = [
    "a@b.c_d@e.f x@y.z.w- @no.pe a@b a@@b.c %@x.yy", "1.2.3.4.5.6.7.8 999.1.1.1.1 1.2.3 01.002.255.256 0000001.1.1.1 1.1.1.1x",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 4111  111111111111 12 34 4111111111111111 41111111111111110000",
    "+1 (555) 555-1234 +12345 +1234567890123456 ++12 34567890. +1.2.3.4.5.6.7.8.9.0 +1(2)-", "é" * 5 + "4111111111111111" + "👩" + " q@r.st",
    "9" * 5000 + " " + "a.b-" * 3000 + " " + "1 " * 3000, "4111 1111 1111 1111 a@4111111111111111.com", "x4111111111111111y", "378282246310005",
]


def check(rows, got):
    assert len(got) == len(rows)
    want = {(i, t): brute(t) for i, t in rows}
    by = {}
    for i, t in rows:
        spans = want[(i, t)]
        s = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        by.setdefault(i, []).append((*(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(s.encode()).hexdigest()))
    mine = {}
    for r in got:
        mine.setdefault(r["doc_id"], []).append((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in mine.items()}


def test_base_spans_match_brute_force(spark):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(EDGE))]
    check(rows, pii.report(documents(spark, rows)).collect())


def test_on_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    check(rows, pii.report(spark.read.parquet(path)).collect())


def test_empty_table(spark):
    assert pii.report(documents(spark, [])).collect() == []
    assert pii.redact(documents(spark, [])).columns == documents(spark, []).columns


def test_context_discovers_unseen_identifier(spark):
    rows = [(i, f"Some words and card number: {4111111111111111} and more, text {i} here") for i in range(3)]
    cards = ["4242424242424242", "5555555555554444", "378282246310005", "6011111111111117", "5105105105105100", "4012888888881881"]
    rows += [(10 + i, f"please note card number: {c} thanks a lot") for i, c in enumerate(cards)]
    rows += [(30, "the card number: ZX99-4411-AB is secret"), (31, "no number 123456 here at all")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    at = rows[-2][1].index("ZX99")
    assert got[30] == f"context:{at}:{at + 12}"
    assert got[31] == ""
    assert got[10].startswith("card:")


def test_pattern_before_a_small_share_of_seeds(spark):
    rows = [(i, f"alpha{'abcdefghij'[i % 10]}x beta{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} user{i}@mail.com") for i in range(900)]
    rows += [(1000 + i, f"account no: 10.0.0.{i} is closed") for i in range(6)]
    rows += [(1100 + i, f"some of the 10.0.1.{i}") for i in range(6)] + [(1200 + i, "some of the people") for i in range(60)]  # by chance
    rows += [(2000, "the account no: ZX99-4411-AB is secret"), (2001, "all of the QQ99-4411-AB parts")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    at = rows[-2][1].index("ZX99")
    assert got[2000] == f"context:{at}:{at + 12}"
    assert got[2001] == ""


OUTER = re.compile(r"(?<!\S)(?:[^\w:=#\s]|_)+|(?:[^\w:=#\s]|_)+(?!\S)")
CORE = re.compile(r"^[\W_]+|[\W_]+$")


def words(text):
    return OUTER.sub("", re.sub("[0-9]+", "0", text.lower())).split()


def brute_patterns(text, start, end):
    left, right = words(text[:start]), words(text[end:])
    found = [f"l {left[-1]}"] if left else []
    found += [f"l {left[-2]} {left[-1]}"] if len(left) > 1 else []
    found += [f"r {right[0]}"] if right else []
    return [p for p in found if re.search(r"[^\W\d_]", p[2:])]


def brute_discovered(texts):
    """Each text's discovered spans, by plain counting and scoring."""
    seeds, edges, places, totals = collections.defaultdict(collections.Counter), collections.Counter(), [], collections.Counter()
    for k, text in enumerate(texts):
        base = brute(text)
        for a, _, z in base:
            for p in brute_patterns(text, a, z):
                seeds[p][text[a:z]] += 1
        for m in re.finditer(r"(?<!\S)(?=\S*[0-9])\S{6,}", text):
            core = CORE.sub("", m[0])
            a = m.start() + len(m[0]) - len(re.sub(r"^[\W_]+", "", m[0]))
            digits = sum(c.isdigit() for c in core)
            if len(core) < 6 or not (digits >= 4 or (digits and re.search(r"[^\W\d_]", core))) or any(b < m.end() and m.start() < z for b, _, z in base):
                continue
            for p in brute_patterns(text, m.start(), m.end()):
                edges[p, core] += 1
                places.append((k, a, a + len(core), p))
        w = words(text)
        totals.update(w)
        totals.update(f"{x} {y}" for x, y in zip(w, w[1:]))
    base = {p: sum(c.values()) for p, c in seeds.items() if len(c) >= pii.MIN_SEEDS}
    share = {p: min(n, totals[p[2:]]) / totals[p[2:]] for p, n in base.items()}
    scores = dict(share)
    for _ in range(pii.ROUNDS):
        fail = collections.defaultdict(float)
        for (p, w), _n in edges.items():
            if p in scores:
                fail[w] += math.log(max(1 - scores[p], 1e-9))
        support = collections.Counter()
        for (p, w), n in edges.items():
            if p in scores:
                support[p] += n * (1 - math.exp(fail[w]))
        scores = {p: min(1.0, share[p] + support[p] * share[p] / totals[p[2:]]) for p in scores}
    return {k: sorted({(a, z) for i, a, z, p in places if i == k and scores.get(p, 0) >= pii.CONFIDENCE}) for k in range(len(texts))}, scores


def test_discovery_matches_brute_force(spark):
    rnd = random.Random(5)
    filler = [f"w{c}" for c in "abcdefghij"]
    cues = [("card no:", ""), ("my ip is", "today"), ("user", "signed in"), ("account", ""), ("(ref", "closed)")]
    texts = []
    for i in range(160):
        parts = rnd.choices(filler, k=rnd.randrange(3, 9))
        for _ in range(rnd.randrange(4)):
            before, after = rnd.choice(cues)
            thing = rnd.choice([f"10.0.{i % 250}.{rnd.randrange(250)}", f"u{i}@mail.example", "4111111111111111", f"+1 555 010 {rnd.randrange(1000, 9999)}", f"ID-{rnd.randrange(30)}-7Q", f"{rnd.randrange(10**7, 10**7 + 20)}", "plain"])
            parts += [before, thing + rnd.choice(["", "", ",", "."]), after] + rnd.choices(filler, k=rnd.randrange(3))
        texts.append(" ".join(x for x in parts if x))
    want, scores = brute_discovered(texts)
    assert sum(map(bool, want.values())) > 20 and any(s < pii.CONFIDENCE for s in scores.values())
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    mine = {k: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x.startswith("context")] for k, s in got.items()}
    assert mine == want


def test_patterns_on_the_right_and_of_one_word(spark):
    rows = [(i, f"{'abcdefg'[i]}x bought from 10.1.1.{i} per router") for i in range(7)] + [(20 + i, f"q{i} from the shop per day") for i in range(2)]
    rows += [(50, "seen ZX99-4411-AB per router"), (51, "hello AB12-CD34 there")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    assert got[50] == "context:5:17" and got[51] == ""


def test_long_chains_and_many_matches(spark):
    rows = [(1, "a@" + "b." * 100_000 + "c"), (2, "-" * 200_000 + "1x" + "." * 200_000 + "y"), (3, "x@y.z " * 20_000), (4, "1." * 100_000), (5, "+1 " * 50_000), (6, "a1" * 100_000 + " " + "@" * 100_000)]
    got = {r["doc_id"]: r for r in pii.report(documents(spark, rows)).collect()}
    assert got[1]["spans"] == "email:0:200003" and got[2]["spans"] == got[5]["spans"] == got[6]["spans"] == ""
    assert got[3]["spans"] == ",".join(f"email:{i}:{i + 5}" for i in range(0, 120_000, 6))
    assert got[4]["spans"] == ",".join(f"ip:{i}:{i + 7}" for i in range(0, 200_000, 8))


def test_bit_table_only_saves_work(spark, monkeypatch):
    rows = [(i, f"account no: 10.0.0.{i} is closed") for i in range(6)] + [(9, "the account no: ZX99-4411-AB is secret")]
    want = sorted(pii.report(documents(spark, rows)).collect())
    monkeypatch.setattr(pii, "TABLE_BITS", 6)  # nearly full
    assert sorted(pii.report(documents(spark, rows)).collect()) == want


def test_plan_is_native(spark):
    plan = pii.report(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redact(spark):
    got = {r["doc_id"]: r for r in pii.redact(documents(spark, [(1, "mail bob@example.com now"), (2, None), (3, "é 10.0.0.1!")])).collect()}
    assert got[1]["text"] == "mail <EMAIL> now" and got[1]["n_chars"] == len("mail <EMAIL> now")
    assert got[2]["text"] is None and got[3]["text"] == "é <IP>!" and got[3]["key"] == "k"
