from collections import Counter

import corpus_pipeline as pipeline
import pytest

from weirlog.llm import mixing, neardup, pii, quality

from cases import documents, empty


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('docs')}"
    documents(spark, extra=False).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_hand_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
    assert docs.count() > 0


def test_each_stage_as_by_hand(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = lambda f: Counter((r["doc_id"], r["text"]) for r in f.collect())
    scored = quality.score(docs, labels).filter("predicted = 1").count()
    assert pipeline.judge(spark, docs, folder).count() == scored
    classes = neardup.join(docs).collect()
    kept = pipeline.join_copies(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} >= {r["class_id"] for r in classes if r["class_id"] is not None}
    assert neardup.join(kept).filter("n_links > 0").count() == 0
    clean = {(r["doc_id"], pii.redacted(r["text"], pii.spans(r["text"])) if r["text"] is not None else None) for r in docs.collect()}
    assert set(texts(pipeline.put_out_pii(spark, docs, folder))) == clean
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r["doc_id"]] += r["times"]
    assert Counter(r["doc_id"] for r in pipeline.mix(spark, docs, folder).collect()) == +times


def test_run(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_empty_table(spark, folder):
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
