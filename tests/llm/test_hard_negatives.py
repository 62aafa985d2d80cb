import math

import numpy as np
import pytest

from onsetframe.llm import hard_negatives as hard

SCHEMA = "embedding array<float>, vec_id long, label int, anchor_id long, block int"
WIDE = SCHEMA.replace("float", "double")


def brute(rows, every=100, top=5):
    ready, seen = [], set()
    sizes = [len(v) for i, label, v in rows if usable(i, label, v)]
    width = max(sizes, key=lambda d: (sizes.count(d), d), default=0)
    for i, label, v in rows:
        if usable(i, label, v) and len(v) == width:
            row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in v))
            if row not in seen:
                seen.add(row)
                ready.append(row)
    anchors, out = {}, []
    for i, label, v in ready:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (label, v) in anchors.items():
        near = [(sum(x * y for x, y in zip(v, w)), i, g) for i, g, w in ready if i != a]
        near = sorted((-min(max(s, hard.LEAST_SCORE), hard.MOST_SCORE), i, g) for s, i, g in near)
        for ps, p, _ in [x for x in near if x[2] == label][:top]:
            fit = [(s, i) for s, i, g in near if g != label and 80 * -ps <= 100 * -s <= 100 * -ps][:top]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def usable(i, label, v):
    return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(spark, rows, schema=SCHEMA):
    out = hard.mine_hard_negatives(spark.createDataFrame([(v, i, g, 3, 4) for i, g, v in rows], schema))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(count, width=8, seed=1, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    of = rng.integers(0, groups, count)
    x = (centres[of] + 0.3 * rng.normal(size=(count, width))).astype(np.float32)
    return [(i, int(of[i] % 3 if rng.random() < 0.7 else rng.integers(0, 10)), x[i].tolist()) for i in range(count)]


def test_same_as_brute_force(spark):
    rows = clustered(1500)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 200


def test_many_blocks_tiles_and_sets(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("TILE", 2), ("ASKED", 3), ("PROBE", 10), ("FIT_VECTORS", 200)):
        monkeypatch.setattr(hard, name, value)
    rows = clustered(1000, width=6, seed=2) + [(2000 + i, 1, [0.5, 0.25, 1.0, 0.0, 0.0, 1.0]) for i in range(150)]  # ties in one crowded cell
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(0, 1, None), (None, 1, [1.0]), (100, None, [1.0])],
    [(100, 1, [1.0, 2.0])],
    [(100, 1, [1.0, 2.0]), (101, 1, [1.0, 2.0])],  # no other label
    [(100, 1, [1.0, 0.0]), (101, 1, [-1.0, 0.0]), (102, 2, [-0.9, 0.0])],  # a negative score opens no window
    [(100, 1, [0.0, 0.0]), (101, 1, [1.0, 0.0]), (102, 2, [3.0, 1.0]), (103, 2, [0.0, 1.0])],  # zero vectors take part
    [(100, 1, [1.0, 1.0]), (101, 1, [1.0, 1.0]), (101, 1, [1.0, 1.0]), (102, 2, [1.0, 0.9]), (102, 2, [1.0, 0.9]), (100, 1, [1.0, 1.0])],
    [(100, 1, [1.0, 1.0]), (100, 0, [0.5, 1.0]), (101, 0, [1.0, 1.0]), (102, 2, [1.0, 0.9]), (102, 3, [0.9, 0.9])],  # unlike rows of one id
    [(100, 1, [1.0, float("nan")]), (200, 1, [1.0, None]), (300, 2, [float("inf"), 1.0]), (400, 3, [1.0]), (500, 2, [1.0, 1.0]), (3, 2, [2.0, 1.0]), (4, 5, [1.0, 1.0])],
    [(100, 4, []), (101, 4, [])],
])
def test_edges(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    big = 2.0**28
    rows = [(100, 1, [big, 3.0, 1.0]), (101, 1, [big, 2.0, 5.0])] + [(102 + i, 2, [big - i / 256, 1.0 * i, 0.0]) for i in range(6)]
    got = mined(spark, rows, WIDE)
    assert got == brute(rows) and got[0][4] > 2**70 // 2**10
    huge = [(100, 1, [1e30, 1.0]), (101, 1, [1e30, 2.0]), (102, 2, [1e30, 1.0]), (103, 3, [-1e30, 1.0])]
    assert mined(spark, huge, WIDE) == brute(huge) != []


def test_bounds_hold_and_cells_come_in_order():
    rng = np.random.default_rng(5)
    x, q = hard.quantised(rng.normal(size=(400, 7))), hard.quantised(rng.normal(size=(9, 7)))
    first, second = hard.k_means(x[:, :3], 8), hard.k_means(x[:, 3:], 6)
    (c1, d1), (c2, d2) = hard._of(x[:, :3], first), hard._of(x[:, 3:], second)
    radius = [np.array([d[c == i].max(initial=0) for i in range(n)]) for d, c, n in ((d1, c1, 8), (d2, c2, 6))]
    index = hard.Index(3, first, second, *radius, np.ones((8, 6), np.int64))
    one, other = index.half_bounds(q)
    assert (one[:, c1] + other[:, c2] >= hard.products(q, x)).all()
    cells = list(index.traversal(one[0], other[0]))
    assert len(cells) == 48 and [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
