"""The corpus pipeline's stages on a small table with planted cases."""

import numpy as np
import pytest

import corpus_pipeline

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(WORDS, 60)) for _ in range(160)]
    texts[20] = texts[3]
    texts[21] = " ".join(texts[4].split()[:58] + ["new", "end"])
    passage = " ".join(r.choice(WORDS, 15))
    texts[30] = texts[30] + " " + passage + " tail"
    toxic = [0] * 160
    for i in range(40, 160, 6):
        w = texts[i].split()
        for k, x in enumerate(("grobnik", "vilez", "grobnika")):
            w.insert(7 * k + 3, x)
        texts[i], toxic[i] = " ".join(w), 1
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "a null key of its own", None, "s", 21), (902, "repeated row", "en", "s", 12), (902, "repeated row", "en", "s", 12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), texts, toxic, passage


def test_stages(spark, sf):
    root, texts, toxic, passage = sf
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        docs.write.parquet(f"{root}/out{k}")
        docs = spark.read.parquet(f"{root}/out{k}")
        if k == 3:
            rows = {r.doc_id: r for r in docs.collect()}
    clean = {i for i, t in enumerate(toxic) if not t}
    assert set(rows) == (clean - {20, 21}) | {900, 901, None, 902}
    assert rows[900].text is None or rows[900].text == ""
    assert passage not in rows[30].text and rows[30].text.endswith("tail") and rows[30].n_chars == len(rows[30].text)
    assert all(rows[i].text == texts[i] for i in clean - {20, 21, 30})
    assert {r.doc_id for r in docs.collect()} == set(rows)


def test_stages_of_empty_tables(spark, sf, tmp_path):
    root = sf[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
