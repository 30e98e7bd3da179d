import corpus_pipeline
from tramline.llm import queries

from .cases import ODD, SCHEMA, documents


def folder(spark, tmp_path, docs, labels, bench):
    at = f"file://{tmp_path}"
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def stages(spark, at, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        out.append(docs.collect())
    return out


def test_stages_take_effect(spark, tmp_path):
    words = [f"w{i}" for i in range(500)]
    text = lambda k, n=80: " ".join(words[(k * 37 + j * j * (k % 7 + 1) + j) % 500] for j in range(n))
    rows = [(i, text(i)) for i in range(60)]
    rows += [(100 + i, text(200 + i) + " vilestword vilestword " + text(300 + i)) for i in range(30)]
    rows += [(200, text(3)), (201, text(4) + " tail"), (202, "before " + text(900, 30) + " after"), (203, text(77) + " mail me@example.com")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(30)]
    at = folder(spark, tmp_path, documents(spark, rows), labels, [(1, text(900, 30))])
    toxic, single, clean, masked, tokens = stages(spark, at, documents(spark, rows))
    ids = lambda r: {x["doc_id"] for x in r}
    assert ids(toxic) == {i for i, _ in rows} - set(range(100, 130))
    assert ids(single) == ids(toxic) - {200, 201}
    assert ids(clean) == ids(single) - {202}
    assert ids(masked) == ids(clean) == ids(tokens)
    by = {r["doc_id"]: r["text"] for r in masked}
    assert by[203].endswith(" mail <EMAIL>") and by[5] == dict(rows)[5]
    assert all([f.name for f in SCHEMA] == list(r[0].asDict()) for r in (toxic, single, clean, masked))
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, tokens))


def test_odd_rows(spark, tmp_path):
    at = folder(spark, tmp_path, documents(spark), [], [])
    toxic, single, clean, masked, tokens = stages(spark, at, documents(spark))
    assert len(toxic) == len(ODD)
    texts = lambda r: sorted(str(x["text"]) for x in r)
    assert len(single) < len(toxic) and len(tokens) == len(masked) == len(clean) == len(single)
    assert texts(clean) == texts(single)
    for part in stages(spark, at, documents(spark, [])):
        assert part == []


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
