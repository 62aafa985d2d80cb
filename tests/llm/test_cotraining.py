import numpy as np

from onsetframe.llm import cotraining


def test_documents_that_no_fit_has_seen(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    out = [r for r in cotraining.cotrained_scores(docs, labels.where("doc_id % 3 <> 0")).collect() if r.doc_id in held]
    assert np.mean([r.kept == bool(held[r.doc_id]) for r in out]) > 0.95
    clean = [r.kept for r in out if held[r.doc_id]]
    assert np.mean(clean) > 0.98


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long, label int, content string"
    rows = [(i, ("###$$ | " if i % 4 == 0 else "Plain words here. ") * (3 + i % 5), f"s{i % 3}", "en", 40 + i, 1, "c") for i in range(160)]
    rows += [(None, None, None, None, None, None, None), (900, "", "s1", "en", 0, 1, "c"), (901, "x " * 60_000, None, None, 120_000, 1, "c"), (3, "Plain words here.", "s0", "en", 17, 1, "c")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)] + [(7777, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = cotraining.cotrained_scores(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id % 4 != 0) for r in out if r.doc_id is not None and 120 <= r.doc_id < 160)
    assert all(0 <= r.score <= 1 for r in out)
    one_class = cotraining.cotrained_scores(docs, labels.where("quality = 1")).collect()
    assert all(r.kept and r.score is None for r in one_class)
    assert cotraining.cotrained_scores(docs.limit(0), labels).count() == 0
