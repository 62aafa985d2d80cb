import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetframe.functions import ranking, tails
from onsetframe.operators import relevance


def long_table(spark, features, labels, label_type="double"):
    rows = [(name, None if v is None else float(v), y) for name, values in features.items() for v, y in zip(values, labels)]
    return spark.createDataFrame(rows, f"name string, value double, label {label_type}")


def kendall_by_hand(x, y):
    n, s = len(x), 0
    for i, j in combinations(range(n), 2):
        s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    tx, ty = ([list(v).count(u) for u in set(v)] for v in (x, y))
    pairs = [sum(t * (t - 1) / 2 for t in g) for g in (tx, ty)]
    every, m = n * (n - 1) / 2, n * (n - 1)
    var = (m * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in tx) - sum(t * (t - 1) * (2 * t + 5) for t in ty)) / 18
    var += 2 * pairs[0] * pairs[1] / m
    var += sum(t * (t - 1) * (t - 2) for t in tx) * sum(t * (t - 1) * (t - 2) for t in ty) / (9 * m * (n - 2))
    return s / math.sqrt((every - pairs[0]) * (every - pairs[1])), math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2))


def fisher_by_hand(a, b, c, d):
    n1, n2, m = a + b, c + d, a + c
    chance = {k: math.comb(n1, k) * math.comb(n2, m - k) for k in range(max(0, m - n2), min(n1, m) + 1)}
    return sum(v for v in chance.values() if v <= chance[a] * (1 + 1e-7)) / math.comb(n1 + n2, m)


# --- ranks ----------------------------------------------------------------------------


def test_close_values_do_not_crowd_a_bucket(spark):
    """200,000 scores in [0.999, 1): the largest bucket holds less than 1% of them."""
    scores = spark.range(200_000).select((0.999 + F.col("id") * 5e-9).alias("v"), F.lit(1).alias("n"))
    sizes = []
    original = ranking._histogram

    def spied(rows, *rest):
        out = original(rows, *rest)
        sizes.append(out)
        return out

    ranking._histogram = spied
    try:
        ranked = ranking.with_rows_below(scores, [], "v")
        wrong = ranked.where(F.abs(F.col("rows_below") - (F.col("v") - 0.999) / 5e-9) > 0.5).count()
    finally:
        ranking._histogram = original
    assert ranked.count() == 200_000 and wrong == 0
    last = sizes[-1].agg(F.max("_rows")).first()[0]
    assert len(sizes) >= 2 and last < 2000


@pytest.mark.parametrize("seed", [0, 1])
def test_ranks_of_awkward_values(spark, seed, monkeypatch):
    monkeypatch.setattr(ranking, "LEAF_ROWS", 3)
    monkeypatch.setattr(ranking, "SPLIT", 4)
    rng = np.random.default_rng(seed)
    values = np.unique(np.r_[
        1 + np.arange(40) * 2.0**-52, -1 - np.arange(9) * 2.0**-51, rng.normal(size=60), 10.0 ** rng.uniform(-300, 300, 40), 0.0, -0.0 + 5e-324,
        np.inf, -np.inf,
    ])
    rows = [(g, float(v), int(rng.integers(1, 9)), int(rng.integers(0, 5))) for g in ("a", "b") for v in rng.permutation(values)[:120]]
    out = ranking.running_totals(spark.createDataFrame(rows, "g string, v double, n long, w long"), ["g"], "v", ["n", "w"]).collect()
    assert len(out) == len(rows)
    for r in out:
        same = [x for x in rows if x[0] == r.g]
        assert (r.n_total, r.w_total) == (sum(x[2] for x in same), sum(x[3] for x in same))
        assert (r.n_below, r.w_below) == (sum(x[2] for x in same if x[1] < r.v), sum(x[3] for x in same if x[1] < r.v))


# --- tails ----------------------------------------------------------------------------


def test_erfc_and_kolmogorov(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.9, 2.999, 3.0, 3.1, 4.0, 6.0, 10.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tails.erfc(F.col("x")).alias("e"), tails.kolmogorov(F.col("x")).alias("k"))
    for r in got.collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-14 if r.x < 3 else 0)
        want = 1.0 if r.x < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * r.x * r.x) for k in range(1, 200))
        assert r.k == pytest.approx(want, abs=1e-9)


def test_fisher():
    rng = random.Random(1)
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 0, 0, 12), (0, 0, 3, 4), (4, 4, 0, 0), (1, 9, 11, 3), (5, 5, 5, 5)]
    tables += [tuple(rng.randrange(60) for _ in range(4)) for _ in range(300)]
    for t in tables:
        assert tails.fisher_exact(*t) == pytest.approx(fisher_by_hand(*t), rel=1e-8, abs=1e-300), t
    assert 0 < tails.fisher_exact(500_000_300, 499_999_700, 500_000_000, 500_000_000) <= 1


# --- tests of features ----------------------------------------------------------------


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_kendall(spark, monkeypatch, block):
    monkeypatch.setattr(relevance, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    y = rng.integers(0, 25, 150).astype(float)
    features = {
        "follows": y + rng.normal(size=150), "falls": -y, "tied": np.round(y / 8) + rng.integers(0, 2, 150), "noise": rng.normal(size=150),
        "heavy": np.where(rng.random(150) < 0.6, 5.0, rng.integers(0, 9, 150)),
    }
    got = {r.name: r for r in relevance.number_relevance(long_table(spark, features, y.tolist())).collect()}
    for name, x in features.items():
        tau, p = kendall_by_hand(x, y)
        assert got[name].kind == "real" and got[name].statistic == pytest.approx(tau, abs=1e-12)
        assert got[name].p_value == pytest.approx(p, rel=1e-6, abs=1e-14)


def test_kolmogorov_smirnov(spark):
    rng = np.random.default_rng(4)
    y = np.round(rng.normal(size=300), 1)
    features = {"step": (y > 0.2).astype(float) * 3 - 1, "noise": rng.integers(0, 2, 300).astype(float)}
    got = {r.name: r for r in relevance.number_relevance(long_table(spark, features, y.tolist())).collect()}
    for name, x in features.items():
        one, other = y[x == x.max()], y[x < x.max()]
        distance = max(abs((one <= v).mean() - (other <= v).mean()) for v in y)
        assert got[name].kind == "binary" and got[name].statistic == pytest.approx(distance)
    assert got["step"].p_value < 1e-12 < 0.01 < got["noise"].p_value


def test_classes_one_against_the_rest(spark):
    rng = np.random.default_rng(5)
    y = rng.choice(["a", "b", "c"], 240)
    features = {
        "of_a": (y == "a") * 2 + rng.normal(size=240), "noise": rng.normal(size=240), "flag_b": ((y == "b") ^ (rng.random(240) < 0.1)).astype(float),
        "constant": np.ones(240), "gaps": [None if i % 3 else float(v) for i, v in enumerate(rng.normal(size=240))],
    }
    out = relevance.relevance(long_table(spark, features, y.tolist(), "string"))
    got = {(r.name, r["class"]): r for r in out.collect()}
    assert set(got) == {(f, c) for f in features if f != "constant" for c in "abc"}
    for c in "abc":
        x = features["flag_b"]
        table = [int((((y == c) == s) & (x == v)).sum()) for s in (True, False) for v in (1, 0)]
        assert got["flag_b", c].p_value == pytest.approx(fisher_by_hand(*table), rel=1e-7)
        assert got["flag_b", c].kind == "binary" and got["noise", c].kind == "real"
    assert got["of_a", "a"].relevant and got["flag_b", "b"].relevant and not got["noise", "a"].relevant
    names = {r.name for r in relevance.relevant_for(out).collect()}
    assert {"of_a", "flag_b"} <= names and "noise" not in names
    assert {r.name for r in relevance.relevant_for(out, 3).collect()} <= names


def test_two_classes_give_one_row_and_agree_with_the_rank_sum(spark):
    from onsetframe.operators import tsfeatures

    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    table = long_table(spark, {"x": y + rng.normal(size=200), "n": rng.integers(0, 4, 200)}, y.tolist(), "int")
    tests = {r.name: r for r in relevance.class_relevance(table).collect()}
    z = {r.name: r.z for r in tsfeatures.rank_sum_test(table).collect()}
    assert set(tests) == {"x", "n"}
    for name in tests:
        assert tests[name]["class"] == 1 and tests[name].statistic == pytest.approx(z[name])


@pytest.mark.parametrize("label_type", ["double", "string"])
def test_empty_and_useless_tables(spark, label_type):
    schema = f"name string, value double, label {label_type}"
    value = 1.0 if label_type == "double" else "a"
    for rows in ([], [("f", None, value)], [("f", 1.0, None)], [("f", 1.0, value), ("f", 1.0, value)], [("f", 1.0, value), ("f", 2.0, value), ("f", 3.0, value)]):
        table = spark.createDataFrame(rows, schema)
        out = relevance.relevance(table, numeric=label_type == "double").collect()
        assert not any(r.relevant for r in out)
