import math

import pytest

from onsetframe.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, n long, model string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "m") for d, t in rows], SCHEMA)


def brute(rows, targets):
    """The same models, counted word by word."""
    texts = [(d, (t or "").lower().split()) for d, t in rows]
    counts = {}
    for _, words in texts:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    common = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: lm.VOCABULARY]
    known = {w: i for i, w in enumerate(common, start=1)}
    number = lambda words: [len(known) + 1, *[known.get(w, 0) for w in words]]
    models = []
    for docs in ([w for d, w in texts if d in targets], [w for _, w in texts]):
        word, before, pair = {}, {}, {}
        for words in docs:
            ids = number(words)
            for a, b in zip(ids, ids[1:]):
                word[b] = word.get(b, 0) + 1
                before[a] = before.get(a, 0) + 1
                pair[a, b] = pair.get((a, b), 0) + 1
        models.append((word, before, pair))
    totals = [sum(m[0].values()) for m in models]
    scale = [1.0, totals[0] / totals[1] if all(totals) else 1.0]
    size = len(known) + 2
    out = {}
    for d, words in texts:
        ids, losses = number(words), []
        for (word, before, pair), total, s in zip(models, totals, scale):
            loss, chance = 0.0, total / lm.CELLS
            for a, b in zip(ids, ids[1:]):
                unigram = (word.get(b, 0) * s + lm.SMOOTH) / (total * s + lm.SMOOTH * size)
                weight = lm.BIGRAM_WEIGHT * before.get(a, 0) / max(before.get(a, 0) + chance, 1)
                joint = min(max(pair.get((a, b), 0) - chance, 0) / max(before.get(a, 0), 1), 1)
                loss -= math.log(weight * joint + (1 - weight) * unigram)
            losses.append(loss / len(words) if words else None)
        out[d] = losses
    return out


def test_against_brute_force(spark):
    rows = [(i, " ".join(f"w{(i * k * k) % (7 + i % 5)}" for k in range(1 + i % 17))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Unheard OF words é")]
    targets = {i for i in range(0, 120, 3)}
    wanted = brute(rows, targets)
    out = lm.cross_entropy_difference(table(spark, rows), spark.createDataFrame([(i,) for i in [*targets, 3, 9999]], "doc_id long"))
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(wanted)
    for d, (one, other) in wanted.items():
        if one is None:
            assert got[d].score is None and got[d].n_words == 0
        else:
            assert (got[d].target_loss, got[d].background_loss) == (pytest.approx(one, rel=1e-5), pytest.approx(other, rel=1e-5))
            assert got[d].score == pytest.approx(one - other, abs=1e-5)


def test_models_grow_with_the_corpus(spark):
    small, large = (table(spark, [(i, "x" * 100_000) for i in range(n)]) for n in (1, 4))
    assert lm.table_sizes(small) == (lm.VOCABULARY, lm.CELLS)
    sizes = []
    for n in (10**9, 4 * 10**9, 10**15):
        docs = large.limit(1).withColumn("text", lm.F.lit("x"))
        docs.agg = lambda *_, n=n: type("Agg", (), {"first": staticmethod(lambda: [n])})
        sizes.append(lm.table_sizes(docs))
    assert sizes[0][0] * 2 == pytest.approx(sizes[1][0], abs=2) and sizes[0][1] * 2 == sizes[1][1] and sizes[2][1] == lm.MOST_CELLS


def test_tables_and_id_filter(spark):
    import numpy as np

    from onsetframe.llm import cells

    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 3, 200_000) * (rng.random(200_000) < 0.1) for _ in range(5)]
    rows = spark.createDataFrame([(i,) for i in range(5)], "i int").repartition(5)

    def emit(batches):
        for batch in batches:
            for i in batch.column("i").to_pylist():
                yield cells.packed("a" if i % 2 else "b", tables[i])

    out = cells.summed(rows.mapInArrow(emit, cells.SCHEMA), {"a": 200_000, "b": 200_000})
    assert (out["a"] == tables[1] + tables[3]).all() and (out["b"] == tables[0] + tables[2] + tables[4]).all()
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    kept = {r.doc_id for r in cells.IdFilter(ids, "doc_id").keep(spark.range(6000).selectExpr("id AS doc_id", "'x' AS text"), "doc_id").collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1000 + 0.1 * 5000
    nobody = cells.IdFilter(ids.limit(0), "doc_id")
    assert nobody.keep(ids, "doc_id").count() == 0


def test_good_documents_score_lower(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = "doc_id % 2 = 0"
    scores = lm.cross_entropy_difference(docs, labels.where(f"quality = 1 AND NOT {held}"))
    means = {r.quality: r.m for r in scores.join(labels.where(held), "doc_id").groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "m").collect()}
    assert means[1] + 1 < means[0]


def test_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "b " * 50_000), (2, None)]
    nobody = spark.createDataFrame([], "doc_id long")
    out = lm.cross_entropy_difference(table(spark, rows), nobody).collect()
    assert len(out) == 4 and sorted(r.n_words for r in out) == [0, 3, 3, 50_000]
    assert lm.cross_entropy_difference(table(spark, rows).limit(0), nobody).count() == 0
