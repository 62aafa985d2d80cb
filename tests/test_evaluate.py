import math

import numpy as np
import pytest

from onsetframe.operators import evaluate as ev


def one(df):
    return df.first().asDict()


def test_binary_example(spark):
    df = spark.createDataFrame([(0, 0.4), (1, 0.6), (0, 0.3), (1, 0.8)], "truth int, score double")
    confusion = ev.confusion_counts(ev.with_class(df))
    assert one(ev.summary(confusion)) == {"accuracy": 1.0, "f1_score": 1.0, "precision": 1.0, "recall": 1.0,
                                          "mcc": 1.0, "kappa": 1.0}
    assert one(ev.auc_of_classes(confusion))["roc_auc"] == one(ev.auc_of_scores(df))["roc_auc"] == 1.0
    assert one(ev.log_loss(df))["log_loss"] == pytest.approx(-np.mean(np.log([0.6, 0.6, 0.7, 0.8])))
    assert [r.predicted for r in ev.with_class(df, 0.6).orderBy("score").collect()] == [0, 0, 0, 1]
    metrics = {r.metric: r.value for r in ev.evaluate(df).collect()}
    assert metrics["accuracy"] == 1.0 and metrics["roc_auc_scores"] == 1.0 and len(metrics) == 9


def test_classes_example(spark):
    raw = [(0, [0.1, 0.5, 0.4]), (1, [0.3, 0.4, 0.3]), (2, [0.2, 0.1, 0.7]), (1, [0.5, 0.4, 0.1])]
    df = spark.createDataFrame(raw, "truth int, scores array<double>")
    classed = ev.with_class(df)
    assert [r.predicted for r in classed.collect()] == [1, 1, 2, 0]
    confusion = ev.confusion_counts(classed)
    assert one(ev.summary(confusion))["accuracy"] == 0.5
    assert one(ev.auc_of_classes(confusion))["roc_auc"] is None
    assert one(ev.log_loss(df))["log_loss"] == pytest.approx(-np.mean(np.log([0.1, 0.4, 0.7, 0.4])))
    assert "roc_auc_scores" not in {r.metric for r in ev.evaluate(df).collect()}
    ties = spark.createDataFrame([(0, [0.5, 0.5])], "truth int, scores array<double>")
    assert ev.with_class(ties).first().predicted == 0


def by_hand(y, p):
    classes = sorted(set(y) | set(p))
    out = {}
    for k in classes:
        tp = sum(a == k == b for a, b in zip(y, p))
        chosen, support = list(p).count(k), list(y).count(k)
        prec, rec = tp / chosen if chosen else 0.0, tp / support if support else 0.0
        out[k] = (prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0, support)
    return out


def test_report_and_matrix(spark):
    rng = np.random.default_rng(9)
    y, p = rng.integers(0, 4, 200).tolist(), rng.integers(1, 6, 200).tolist()
    df = spark.createDataFrame(list(zip(y, p)), "truth int, predicted int")
    confusion = ev.confusion_counts(df)
    want = by_hand(y, p)
    rows = {r["class"]: tuple(r)[1:] for r in ev.report(confusion).collect()}
    for k, values in want.items():
        assert rows[str(k)] == pytest.approx(values)
    macro = np.mean([v[:3] for v in want.values()], axis=0)
    weighted = np.average([v[:3] for v in want.values()], axis=0, weights=[v[3] for v in want.values()])
    assert rows["macro avg"][:3] == pytest.approx(macro) and rows["weighted avg"][:3] == pytest.approx(weighted)
    cells = {(r.truth, r.predicted): (r.n, r.share) for r in ev.confusion_matrix(confusion).collect()}
    assert len(cells) == len(want) ** 2
    for (a, b), (n, share) in cells.items():
        assert n == sum(i == a and j == b for i, j in zip(y, p))
        assert share == (pytest.approx(n / y.count(a)) if y.count(a) else 0)
    s = one(ev.summary(confusion))
    n, c = 200, sum(a == b for a, b in zip(y, p))
    t, q = [y.count(k) for k in want], [p.count(k) for k in want]
    cross = sum(a * b for a, b in zip(t, q))
    assert s["mcc"] == pytest.approx(
        (c * n - cross) / math.sqrt((n**2 - sum(v * v for v in q)) * (n**2 - sum(v * v for v in t))))
    assert s["kappa"] == pytest.approx((c / n - cross / n**2) / (1 - cross / n**2))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "truth int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert one(ev.auc_of_scores(df))["roc_auc"] == pytest.approx(want)
    assert one(ev.auc_of_scores(df.where("truth = 1")))["roc_auc"] is None
    assert one(ev.auc_of_classes(ev.confusion_counts(ev.with_class(df.where("truth = 1")))))["roc_auc"] is None
    single = ev.confusion_counts(ev.with_class(df.where("truth = 1"), -1.0))
    assert one(ev.summary(single))["mcc"] == 0.0


def test_certain_and_wrong_scores_are_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "truth int, score double")
    assert one(ev.log_loss(df))["log_loss"] == pytest.approx(-math.log(ev.EPS) / 2)
