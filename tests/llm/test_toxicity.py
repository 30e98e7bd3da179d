import math
import zlib

from tramline.llm import toxicity

from .cases import ODD, documents


def labels(spark, rows):
    return spark.createDataFrame([(i, 1, y, "x", "t") for i, y in rows], "doc_id long, quality int, toxic int, score string, text string")


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, own = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.predictions(docs, own)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.where("held_out").join(own, "doc_id").collect()
    toxic = [r["score"] for r in rows if r["toxic"]]
    clean = [r["score"] for r in rows if not r["toxic"]]
    wins = sum(sum(t > c for c in clean) + 0.5 * sum(t == c for c in clean) for t in toxic) / len(toxic) / len(clean)
    assert wins > 0.93
    assert sum(s >= 0.7 for s in toxic) > 0.85 * len(toxic) and sum(s >= 0.7 for s in clean) < 0.01 * len(clean)


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = own.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.predictions(docs, own).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.predictions(docs, flipped).collect()}
    assert a == b


def test_odd_rows(spark):
    own = labels(spark, [(1, 0), (4, 1), (5, 0), (5, 1), (None, 1), (6, None), (8, 7)])
    got = toxicity.predictions(documents(spark), own).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len(toxicity.predictions(documents(spark), labels(spark, [])).collect()) == len(ODD)
    assert toxicity.predictions(documents(spark, []), own).collect() == []
    kept = toxicity.drop_toxic(documents(spark), labels(spark, []))
    assert kept.columns == documents(spark).columns and kept.count() == len(ODD)


def test_an_id_of_many_rows_is_one_training_row(spark):
    a, b, c, d = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    rows = [(a, f"some text {i}") for i in range(50)] * 2 + [(b, "other words"), (c, None), (c, None), (d, "more")]
    got = toxicity.training_rows(documents(spark, rows), labels(spark, [(a, 1), (a, 0), (b, 0), (c, 0), (d, 1)])).collect()
    assert len(got) == 4 and [r["label"] for r in got if (r["text"] or "").startswith("some")] == [1]


IDIOT = {"idiot$": (3.0, 3.0, 3.0)}


def test_contexts_are_told_apart():
    s = toxicity.Scorer(toxicity.Model(IDIOT, [0.0] * toxicity.N_FEATURES))
    kinds = {"you are an idiot": (4, 5), "what an idiot": (4,), "he is not an idiot": (4, 6), "she said idiot there": (4, 7), 'the word "idiot" again': (4, 7), "an idiot. not here": (4,)}
    for text, at in kinds.items():
        f = s.features(text)
        assert tuple(k for k in range(4, 10) if f[k]) == at, text
    assert s.features("nice words only")[1] == 0 and s.features(None)[0] == 1


def test_threats_weigh_by_verb_and_target():
    s = toxicity.Scorer(toxicity.Model(IDIOT, [0.0] * toxicity.N_FEATURES))
    threats = {"nice weather tomorrow ok": (0, 0), "to kill time": (2, 0), "i will kill you tomorrow": (2, 2), "they burn": (0, 1), "i kill the man": (2, 0),
               "ich werde dich töten": (0, 2), "i will not kill you": (0, 0), "he said i kill you": (0, 0), '"kill you"': (0, 0), "die you": (0, 0)}
    for text, (bare, aimed) in threats.items():
        f = s.features(text)
        assert math.isclose(math.expm1(f[8]), bare, abs_tol=1e-9) and math.isclose(math.expm1(f[9]), aimed, abs_tol=1e-9), text
    assert s.features("kill the idiot")[4] > 0


def test_every_transducer_moves_scores(spark):
    """Each context is taken out in turn, with the model fitted on sf0.1 held: targets and threats raise scores, the others lower them.

    Targets and negations are taken over all the table's texts, every context in a made sentence around the texts' own insult.
    """
    path = "/root/testdata/sf0.1"
    docs, own = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit(docs, own)
    insult = max((w for w in model.stems if w.endswith("$")), key=lambda w: model.stems[w][0])[:-1]
    texts = [r["text"] for r in docs.select("text").collect()]
    made = {"threat": "we will kill you tomorrow", "report": f"somebody said {insult} there", "quote": f'the word "{insult}" again', "negation": f"he is not {insult} again", "target": f"you are {insult} again"}
    full = toxicity.Scorer(model)
    for name in toxicity.CONTEXTS:
        less = toxicity.Scorer(model, frozenset([name]))
        sign = 1 if name in ("target", "threat") else -1
        assert sign * (full.score(made[name]) - less.score(made[name])) > 0, name
        if name in ("target", "negation"):
            moved = [sign * (full.score(t) - less.score(t)) for t in texts]
            up, down = sum(m > 1e-12 for m in moved), sum(m < -1e-12 for m in moved)
            assert up > 20 and down * 10 <= up, (name, up, down)


def test_a_clause_is_read_from_its_first_token():
    s = toxicity.Scorer(toxicity.Model(IDIOT, [0.0] * toxicity.N_FEATURES))
    f = s.features('"' + "so it goes on and on " * 20 + 'idiot" again')
    assert f[7] < 0 and f[1] == f[5] == f[6] == 0
