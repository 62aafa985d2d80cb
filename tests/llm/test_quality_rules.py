import re

import numpy as np
import pytest

from onsetframe.llm import boosting, quality_rules as q


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
    )


@pytest.mark.parametrize("text", [
    "", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "one\ntwo\none\n\n\none \n", "é à ü ☃ \x1c# *$%&|<>\t\x0b\x0cq",
    "a b c d e f a b c d e f g a b c d e", "w1 w2 w3 w4 w5 w6 w2 w3 w4 w5 w6 w7",
])
def test_statistics(text):
    assert q.statistics(text.encode())[:5] == naive(text)


def test_trees_fit_and_keep_their_signs():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    noisy = np.where(rng.uniform(size=len(y)) < 0.1, 1 - y, y)
    model = boosting.fit(x[:2000], noisy[:2000], {0: -1})
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    for _ in range(50):  # the score never rises with the constrained feature
        row = rng.uniform(0, 1, 3)
        line = np.repeat(row[None], 200, axis=0)
        line[:, 0] = np.linspace(0, 1, 200)
        assert (np.diff(model.margin(line)) <= 1e-12).all()


def test_flat_arrays_agree_with_stepping_down_each_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    model = boosting.fit(x, (x.sum(axis=1) > 0).astype(float), {}, trees=5)

    def step(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (1 if row[model.feature[t, node]] <= model.cut[t, node] else 2)
            total += model.value[t, node]
        return total

    assert model.margin(x) == pytest.approx([step(r) for r in x])


def test_no_model_without_both_classes():
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0), {}) is None
    assert boosting.fit(np.zeros((5, 2)), np.ones(5), {}) is None


def test_documents_that_no_fit_has_seen(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    out = [r for r in q.quality_decisions(docs, labels.where("doc_id % 3 <> 0")).collect() if r.doc_id in held]
    right = [r.base_failed or r.kept == bool(held[r.doc_id]) for r in out]
    assert np.mean(right) > 0.97


def test_edges(spark):
    schema = "doc_id long, text string, kept string, score int, n_words int"
    good, bad = "Plain words in a sentence that goes on for a while, %d of them.", "###$$$ %d ### || && ** ### || && ** ## $$ %%"
    rows = [(i, (good if i % 2 else bad).replace("%d", str(i)), "c", 1, 1) for i in range(200)]
    rows += [(None, None, None, None, None), (900, "", "c", 1, 1), (901, good, "c", 1, 1), (901, good, "c", 1, 1), (902, "word " * 30_000, "c", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in q.quality_decisions(docs, labels).collect()}
    assert out[None].base_failed and out[900].base_failed and not out[900].kept
    assert out[902].base_failed and out[902].n_repeat_words == 30_000
    assert all(out[i].kept == bool(i % 2) for i in range(150, 200))
    kept = q.keep_good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(1, 200, 2), 901, 901])
    assert all(r.kept != r.base_failed for r in q.quality_decisions(docs, labels.limit(0)).collect())
    assert q.quality_decisions(docs.limit(0), labels).count() == 0
    assert q.keep_good_documents(docs.limit(0), labels).count() == 0
