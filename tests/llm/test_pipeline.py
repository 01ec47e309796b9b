"""The pipeline's stages on a small folder, each against what its operator says of its own input."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from spindle.llm import minhash, mixing, quality, secrets


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{base}/{name}")
        out.append((name, docs, spark.read.parquet(f"{base}/{name}")))
        docs = out[-1][2]
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_columns_stay(stages, spark, sf):
    want = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [name for name, *_ in stages] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(after.columns == want for _, _, after in stages[:-1])


def test_quality_drops_what_it_rejects(stages, spark, sf):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    said = {r.doc_id: r.predicted for r in quality.classify(before, labels).collect()}
    assert ids(after) == Counter(d for d in ids(before) if said[d])
    clean = {r.doc_id for r in labels.where("quality = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert len(clean & set(ids(after))) >= 0.95 * len(clean & set(ids(before)))


def test_one_of_each_class(stages):
    _, before, after = stages[1]
    assert ids(after) == Counter({r.class_id for r in minhash.classes(before).collect()})


def test_secrets_go_and_documents_stay(stages):
    _, before, after = stages[2]
    assert ids(before) == ids(after) and secrets.scan(after).where("spans <> ''").count() == 0
    same = {r.doc_id: r.text for r in before.collect()}
    found = {r.doc_id for r in secrets.scan(before).where("spans <> ''").collect()}
    assert all((r.text != same[r.doc_id]) == (r.doc_id in found) and r.n_chars == len(r.text) for r in after.collect())


def test_mixture_is_taken(stages):
    _, before, after = stages[3]
    want = Counter({r.doc_id: r.taken // r["size"] for r in mixing.mix(before).collect() if r["size"] and r.taken})
    assert ids(after) == want


def test_everything_is_packed(stages):
    _, before, after = stages[4]
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == ids(before)
    full = after.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in full) <= 2048


def test_run(spark, sf, stages):
    """All stages in a row give the pieces that they give one by one; in which sequence a piece stands is the tasks' matter."""
    pieces = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    out = corpus_pipeline.run(spark, sf)
    assert pieces(out) == pieces(stages[-1][2])
    places = sorted((r.sequence_id, r.offset, r.length) for r in out.collect())
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip([(None, 0, 0), *places], places))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_names(name, spark, sf, documents, empty, clashing):
    """Null and empty texts, null and repeated doc_ids, no rows, further columns of the operators' own names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, sf).count() == 0
    plain, out = stage(spark, documents, sf), stage(spark, clashing, sf)
    if name == "packing":
        assert out.columns == plain.columns and out.agg({"length": "sum"}).first() == plain.agg({"length": "sum"}).first()
        return
    assert plain.columns == documents.columns and out.columns == clashing.columns
    first = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).select(*[f"c{i}" for i in range(5)])
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
