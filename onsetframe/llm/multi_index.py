"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a cell. A query visits
cells in the order of the summed distance of its halves (here: the negative inner product with both
centroids), by a heap over pairs, until the cells hold enough entries. How many are enough is measured:
a bounded set of queries is answered by brute force over all rows, and the budget is what reaches
``RECALL`` of their neighbours. Visited entries are ranked by the exact inner product.

Entries and queries meet in blocks: some first centroids, or a part of the entries of a crowded one, and
a set of queries that visit it, so no crowded cell and no number of queries makes a task large; an entry is copied only for
the sets that visit its block. Bounded on the driver: the codebooks and
their sample, one count per cell, the calibration queries and their neighbours.

Defined results: vectors that are null, zero, of another than the commonest length, or with null
or non-finite components take no part; a row never finds rows of its own vec_id; repeated rows count
once; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.session import checkpointed

TOP = 20
QUERY_EVERY = 20
RECALL = 0.96
FIT_VECTORS = 16_384
CALIBRATION_QUERIES = 96
MOST_CENTROIDS = 1024
LEAST_VISITED = 1024
ROUNDS = 12
ENTRY_BLOCK, QUERY_SET, TILE = 4096, 16_384, 512
# products within this of the last place are ranked by the exact sum
SLACK = 1e-9
FOUND = ["query_id", "vec_id", "score"]


@dataclass
class Index:
    split: int  # components in the first half
    first: np.ndarray  # centroids of either half
    second: np.ndarray
    counts: np.ndarray  # entries in each cell
    visit: int = 0  # entries a query visits at least

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.split], self.first), _nearest(x[:, self.split :], self.second)

    def traversal(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells by growing summed distance."""
        one, other = -self.first @ q[: self.split], -self.second @ q[self.split :]
        a, b = np.argsort(one, kind="stable"), np.argsort(other, kind="stable")
        d, e, a, b = one[a].tolist(), other[b].tolist(), a.tolist(), b.tolist()
        heap, reached = [(d[0] + e[0], 0, 0)], [0] * len(a)
        while heap:
            _, i, j = heappop(heap)
            yield a[i], b[j]
            # the next of this row, and the first of the next row
            if j + 1 < len(b):
                heappush(heap, (d[i] + e[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heappush(heap, (d[i + 1] + e[0], i + 1, 0))

    def blocks(self, size: int) -> tuple[list[int], list[int]]:
        """Block of each first centroid, neighbours sharing one up to ``size`` entries; parts of each block."""
        of, held = [], []
        for n in self.counts.sum(axis=1).tolist():
            if not held or held[-1] + n > size:
                held.append(0)
            held[-1] += n
            of.append(len(held) - 1)
        return of, [max(1, -(-n // size)) for n in held]

    def visited(self, q: np.ndarray, block_of: list[int]) -> dict[int, list[int]]:
        """Numbers of the cells to visit, by block; empty cells are left out."""
        out: dict[int, list[int]] = {}
        seen, width = 0, len(self.second)
        for i, j in self.traversal(q):
            here = int(self.counts[i, j])
            if here:
                out.setdefault(block_of[i], []).append(i * width + j)
                seen += here
                if seen >= self.visit:
                    break
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        of = _nearest(x, centroids)
        size = np.bincount(of, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, of, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    ready = rows.select("vec_id", "embedding").where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sizes = ready.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return ready.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def sampled(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``most`` rows with the smallest md5 of their id."""
    table = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "embedding").limit(most).toArrow()
    return table.column("vec_id").to_numpy(), matrix(table.column("embedding").combine_chunks())


def build_index(vectors: DataFrame) -> tuple[DataFrame, Index] | None:
    """The entries with their cell (kept), and the index; None without a vector."""
    total = vectors.count()
    if not total:
        return None
    _, x = sampled(vectors, FIT_VECTORS)
    k = min(MOST_CENTROIDS, 2 ** max(2, round(np.log2(total) / 4 + 2)))
    split = x.shape[1] // 2
    index = Index(split, k_means(x[:, :split], k), k_means(x[:, split:], k), np.zeros((1, 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = index.cells(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(one, pa.int32()), pa.array(other, pa.int32())], ["vec_id", "embedding", "c1", "c2"]
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    entries = checkpointed(vectors.mapInArrow(assign, f"vec_id long, embedding {kind}, c1 int, c2 int"))
    index.counts = np.zeros((len(index.first), len(index.second)), np.int64)
    for c1, c2, n in entries.groupBy("c1", "c2").count().collect():
        index.counts[c1, c2] = n
    return entries, index


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and exact products of its best entries, ties to smaller ids.

    ``scores`` are products as the matrix multiplication gives them, -inf where not visited. Its
    rounding may differ by place, so what comes near the last place is summed again row by row.
    """
    for row, of in zip(scores, q):
        near = np.flatnonzero(row > -np.inf)
        if len(near) > top:
            last = np.partition(row[near], len(near) - top)[len(near) - top]
            near = near[row[near] >= last - SLACK * max(1.0, abs(last))]
        exact = (x[near] * of).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:top]
        yield near[order], exact[order]


def _few_copies(ids: np.ndarray, x: np.ndarray, top: int) -> np.ndarray:
    """Positions without repeated rows, and without those copies of a vector that ``top`` others with
    smaller ids precede anyway."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, of = np.unique(rows, return_inverse=True)
    by = np.lexsort((ids, of))
    new_vector = np.r_[True, of[by][1:] != of[by][:-1]]
    by = by[new_vector | np.r_[True, ids[by][1:] != ids[by][:-1]]]
    starts = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return by[nth <= top]


def calibrated(entries: DataFrame, index: Index, queries: DataFrame, top: int, recall: float) -> int:
    """Entries to visit so that ``recall`` of the true neighbours of some queries are among them."""
    ids, q = sampled(queries, CALIBRATION_QUERIES)
    if not len(ids):
        return 0

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
            if len(own):
                scores = np.where(ids[:, None] == own[None, :], -np.inf, q @ x.T)
                rows = [(i, p) for i, (at, _) in enumerate(best(scores, q, x, own, top)) for p in at]
                of, at = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), ())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of), pa.array(scores[of, at]), *[batch.column(c).take(pa.array(at)) for c in ("vec_id", "c1", "c2")]],
                    ["query", "score", "vec_id", "c1", "c2"],
                )

    found = entries.mapInArrow(brute, "query long, score double, vec_id long, c1 int, c2 int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    nearest = found.withColumn("rank", rank).where(F.col("rank") <= top).select("query", "c1", "c2").collect()
    wanted: dict[int, list] = {}
    for i, c1, c2 in nearest:
        wanted.setdefault(i, []).append((c1, c2))
    reached = []
    for i, cells in wanted.items():
        seen, upto = 0, {}
        for cell in index.traversal(q[i]):
            seen += int(index.counts[cell])
            upto[cell] = seen
        reached += [upto[c] for c in cells]
    return int(np.quantile(reached, recall)) if reached else 0


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each query among ``vectors``."""
    built = build_index(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if built is None:
        return vectors.sparkSession.createDataFrame([], schema)
    entries, index = built
    index.visit = max(calibrated(entries, index, queries, top, recall), LEAST_VISITED, 2 * top)
    asked = queries.count()
    query_sets = -(-asked // QUERY_SET) or 1
    block_of, parts = index.blocks(ENTRY_BLOCK)
    width = len(index.second)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = [
                    (i, block, cells)
                    for i, v in enumerate(matrix(part.column("embedding")))
                    for block, cells in index.visited(v, block_of).items()
                ]
                at, block, cells = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(at)) for c in ("vec_id", "embedding")], pa.array(block, pa.int32()),
                     pa.array(cells, pa.list_(pa.int32()))],
                    ["query_id", "query", "block", "visit"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    parts_of = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("block") + 1)
    asking = (
        queries.mapInArrow(plan, f"query_id long, query {kind}, block int, visit array<int>")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1)))
        .withColumn("query_set", F.pmod(F.xxhash64("query_id"), F.lit(query_sets)).cast("int"))
    )
    asking = checkpointed(asking) if query_sets > 1 else asking
    held = (
        entries.withColumn("block", F.element_at(F.array(*[F.lit(b) for b in block_of]), F.col("c1") + 1))
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int"))
    )
    if query_sets > 1:
        visits = asking.groupBy("block", "part").agg(F.collect_set("query_set").alias("query_set"))
        held = held.join(visits, ["block", "part"]).withColumn("query_set", F.explode("query_set"))
    else:
        held = held.withColumn("query_set", F.lit(0))

    def meet(q: pa.Table, e: pa.Table) -> pa.Table:
        ids, x = e.column("vec_id").to_numpy(), matrix(e.column("embedding").combine_chunks())
        asked_ids, asked_q = q.column("query_id").to_numpy(), matrix(q.column("query").combine_chunks())
        found = []
        if len(ids) and len(asked_ids):
            once = _few_copies(asked_ids, asked_q, len(asked_ids))
            keep = _few_copies(ids, x, top)
            cell = (e.column("c1").to_numpy().astype(np.int64) * width + e.column("c2").to_numpy())[keep]
            ids, x = ids[keep], x[keep]
            for start in range(0, len(once), TILE):
                at = once[start : start + TILE]
                found += _tile(asked_ids[at], asked_q[at], q.column("visit").take(pa.array(at)).to_pylist(), ids, x, cell)
        columns = [np.concatenate([f[i] for f in found]) for i in range(3)] if found else [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], FOUND)

    def _tile(asked_ids, asked_q, lists, ids, x, cell) -> list[tuple]:
        here, of = np.unique(cell, return_inverse=True)
        visits = np.zeros((len(asked_ids), len(here)), bool)
        for i, cells in enumerate(lists):
            at = np.searchsorted(here, cells)
            known = at < len(here)
            at = at[known]
            visits[i, at[here[at] == np.array(cells)[known]]] = True
        scores = np.full((len(asked_ids), len(ids)), -np.inf)
        for c in range(len(here)):
            who, what = np.flatnonzero(visits[:, c]), np.flatnonzero(of == c)
            if len(who):
                scores[np.ix_(who, what)] = asked_q[who] @ x[what].T
        scores[asked_ids[:, None] == ids[None, :]] = -np.inf
        return [
            (np.full(len(at), own), ids[at], exact + 0.0) for own, (at, exact) in zip(asked_ids, best(scores, asked_q, x, ids, top))
        ]

    key = ["block", "part", "query_set"]
    met = asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    # a query has at most ``top`` rows of each block it visited
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
