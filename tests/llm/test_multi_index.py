import numpy as np

from onsetframe.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, query_id long, c1 int, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "p") for i, v in rows], SCHEMA)


def brute(ids, x, query, top=20):
    scores = (x * x[ids == query][0]).sum(axis=1)
    scores[ids == query] = -np.inf
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), float(scores[i])) for i in order[:top] if ids[i] != query]


def run(spark, rows):
    vectors = multi_index.usable_vectors(table(spark, rows))
    out = {}
    for r in multi_index.search(vectors, vectors.where("vec_id % 20 = 0")).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(found)] for q, found in out.items()}


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    found = {}
    for r in multi_index.op6_multi_index(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == asked
    hits = sum(len({v for v, _ in brute(ids, x, q)} & {v for v, _ in found[q]}) for q in asked)
    assert hits >= 0.9 * 20 * len(asked)
    assert all(len(found[q]) == 20 for q in asked)


def test_recall_where_few_are_visited(spark):
    """Twenty thousand clustered vectors, of which a query visits a part."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(200, 24))
    x = (centres[rng.integers(0, 200, 20_000)] + 0.35 * rng.normal(size=(20_000, 24))).astype(np.float32)
    ids = np.arange(20_000)
    vectors = multi_index.usable_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>"))
    visited, original = [], multi_index.calibrated

    def spied(*args):
        visited.append(original(*args))
        return visited[-1]

    multi_index.calibrated = spied
    try:
        found = {}
        for r in multi_index.search(vectors, vectors.where("vec_id % 100 = 0")).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        multi_index.calibrated = original
    wide = x.astype(float)
    hits = sum(len(found[q] & {v for v, _ in brute(ids, wide, q)}) for q in range(0, 20_000, 100))
    assert hits >= 0.9 * 20 * 200 and max(*visited, multi_index.LEAST_VISITED) < 10_000


def test_small_tables_and_ties_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(100, 160)]  # more equal vectors than places
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    found = run(spark, rows)
    assert found == {q: brute(ids, x, q) for q in (0, 20, 40, 100, 120, 140)}


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(multi_index, "QUERY_SET", 4)
    monkeypatch.setattr(multi_index, "TILE", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 0.01 + 1).astype(np.float32).tolist()) for i in range(300)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    found = run(spark, rows)
    hits = sum(len({v for v, _ in brute(ids, x, q)} & {v for v, _ in found[q]}) for q in found)
    assert len(found) == 15 and hits >= 0.9 * 15 * 20


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]),
        (7, []), (8, [1.0, 2.0, 3.0]), (20, [-1.0, 0.0]), (1, [0.5, 0.5]), (None, [1.0, 1.0]),
    ]
    assert run(spark, rows) == {0: [(1, 0.5), (20, -1.0)], 20: [(1, -0.5), (0, -1.0)]}
    assert run(spark, rows[2:4]) == {}
    assert run(spark, [(20, [1.0])]) == {}
    assert run(spark, [(20, [2.0]), (3, [3.0])]) == {20: [(3, 6.0)]}


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(3)
    index = multi_index.Index(3, rng.normal(size=(7, 3)), rng.normal(size=(5, 2)), np.ones((7, 5), int))
    q = rng.normal(size=5)
    far = [-(index.first[i] @ q[:3] + index.second[j] @ q[3:]) for i, j in index.traversal(q)]
    assert len(far) == 35 and far == sorted(far)
