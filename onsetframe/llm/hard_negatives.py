"""Hard negatives for contrastive training, found exactly with an inverted multi-index.

Two codebooks quantise the halves of the integer vectors; a pair of centroids is a cell. With the radius of
each centroid, ``q.c + |q| r`` bounds what a half can score, and the sum of both halves bounds a cell. A
multi-sequence heap hands an anchor its cells by falling bound. It does so twice: a probe visits the cells
that hold the first ``PROBE`` entries, and its last places give each wanted window of scores a floor;
then the heap runs until the next cell's bound is below every floor. No unseen entry can enter a
window then: the answer is certified, not approximate. First the positives are found so, then the negatives in
the windows that the positives open.

Cells lie in blocks of about ``BLOCK`` entries (crowded first centroids in parts). An anchor goes to the
blocks of the cells its heap reached, in tiles of ``TILE``; an entry is copied only for sets of ``ASKED`` anchors
that visit its block. On the driver: codebooks, the sample they are fitted on, one row for each used cell.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or of another than the
commonest length take no part, zero vectors do. Identical rows count once; an id with unlike rows is asked once, by its
least label and vector, and each of its rows can be found, but not by an anchor of that id. A score beyond 64 bits
becomes the nearest of them. Anchors without positives or without negatives in their windows have no rows; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.llm.multi_index import FIT_VECTORS, k_means, matrix, sampled
from onsetframe.session import checkpointed

ANCHOR_EVERY, FLIP_EVERY, CLASSES = 100, 7, 10
TOP = 5
PROBE = 2048
BLOCK, TILE, ASKED = 4096, 256, 32_768
MOST_CENTROIDS = 512
LEAST_SCORE, MOST_SCORE = -(2**63), 2**63 - 1
# share added to a bound for the rounding of doubles
SLACK = 1e-9


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component, as whole doubles."""
    return np.floor(256.0 * vectors)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles as 64-bit integers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in part], object) for part in (q, x)]
    return np.clip(whole[0] @ whole[1].T, LEAST_SCORE, MOST_SCORE).astype(np.int64)


@dataclass
class Index:
    split: int  # components in the first half
    first: np.ndarray  # centroids of either half, and how far their entries lie at most
    second: np.ndarray
    first_radius: np.ndarray
    second_radius: np.ndarray
    counts: np.ndarray  # entries in each cell

    def half_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most that an entry of each first, and of each second, centroid can add to the score of each row."""
        out = []
        for half, centroids, radius in (
            (q[:, : self.split], self.first, self.first_radius), (q[:, self.split :], self.second, self.second_radius)
        ):
            size = np.sqrt((half**2).sum(axis=1))[:, None]
            reach = size * (np.sqrt((centroids**2).sum(axis=1)) + radius)
            out.append(half @ centroids.T + size * radius + SLACK * (1 + reach))
        return out[0], out[1]

    def traversal(self, one: np.ndarray, other: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Bound and centroids of each cell, by falling sum of the half bounds."""
        a, b = np.argsort(-one, kind="stable"), np.argsort(-other, kind="stable")
        d, e, a, b = (-one[a]).tolist(), (-other[b]).tolist(), a.tolist(), b.tolist()
        heap = [(d[0] + e[0], 0, 0)]
        while heap:
            low, i, j = heappop(heap)
            yield -low, a[i], b[j]
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


# --- index ----------------------------------------------------------------------------


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part, the label moved on for every ``FLIP_EVERY``-th id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ready = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    moved = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    ready = ready.select(F.col("vec_id").cast("long"), moved.cast("long").alias("label"), "embedding")
    sizes = ready.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return ready.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def _of(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
    return at, np.sqrt(((x - centroids[at]) ** 2).sum(axis=1))


def build_index(vectors: DataFrame) -> tuple[DataFrame, Index] | None:
    """The entries with their cell (kept), and the index; None without a vector."""
    total = vectors.count()
    if not total:
        return None
    _, x = sampled(vectors, FIT_VECTORS)
    x = quantised(x)
    k = min(MOST_CENTROIDS, 2 ** max(2, round(np.log2(total) / 4 + 2)))
    split = x.shape[1] // 2
    first, second = k_means(x[:, :split], k), k_means(x[:, split:], k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = quantised(matrix(batch.column("embedding")))
                (one, far), (other, away) = _of(x[:, :split], first), _of(x[:, split:], second)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(one, pa.int32()), pa.array(other, pa.int32()), pa.array(far), pa.array(away)],
                    [*batch.schema.names, "c1", "c2", "d1", "d2"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"vec_id long, label long, embedding {kind}, c1 int, c2 int, d1 double, d2 double"
    entries = checkpointed(vectors.mapInArrow(assign, schema))
    index = Index(split, first, second, np.zeros(len(first)), np.zeros(len(second)), np.zeros((len(first), len(second)), np.int64))
    for c1, c2, n, d1, d2 in entries.groupBy("c1", "c2").agg(F.count("*"), F.max("d1"), F.max("d2")).collect():
        index.counts[c1, c2] = n
        index.first_radius[c1] = max(index.first_radius[c1], d1 * (1 + SLACK))
        index.second_radius[c2] = max(index.second_radius[c2], d2 * (1 + SLACK))
    return entries.drop("d1", "d2"), index


# --- visits ---------------------------------------------------------------------------


def _asks(asked: DataFrame, index: Index, block_of: list[int], probe: int | None) -> DataFrame:
    """``block, asks``: tiles of anchors with the bound ``need`` that a cell must reach to be visited.

    A probe stops once ``probe`` entries were seen, otherwise at the first cell below every window's floor.
    """
    columns = ["anchor_id", "label", "embedding", "lower", "upper", "need"]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                ones, others = index.half_bounds(quantised(matrix(part.column("embedding"))))
                needs, blocks = [], {}
                for i, lower in enumerate(part.column("lower").to_pylist()):
                    seen, floor, last, reached = 0, float(min(lower)), np.inf, set()
                    for bound, c1, c2 in index.traversal(ones[i], others[i]):
                        if bound < floor if probe is None else seen >= probe:
                            break
                        last = bound
                        if index.counts[c1, c2]:
                            seen += int(index.counts[c1, c2])
                            reached.add(block_of[c1])
                    needs.append(last if probe is not None else floor)
                    for block in reached:
                        blocks.setdefault(block, []).append(i)
                rows = pa.StructArray.from_arrays([*[part.column(c) for c in columns[:-1]], pa.array(needs, pa.float64())], columns)
                sizes = np.cumsum([0, *[len(at) for at in blocks.values()]])
                flat = rows.take(pa.array([i for at in blocks.values() for i in at], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(blocks), pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["block", "asks"]
                )

    kind = asked.schema["embedding"].dataType.simpleString()
    ask = f"struct<anchor_id:bigint,label:bigint,embedding:{kind},lower:array<bigint>,upper:array<bigint>,need:double>"
    return asked.select(*columns[:-1]).mapInArrow(plan, f"block int, asks array<{ask}>")


def _once(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of the entries without identical ones."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    rows = np.c_[ids.astype(np.float64), labels.astype(np.float64), x]
    return np.sort(np.unique(rows, axis=0, return_index=True)[1])


def _visit(entries: DataFrame, index: Index, asked: DataFrame, same: bool, top: int, probe: int | None) -> DataFrame:
    """``anchor_id, window, rank, vec_id, score``: the best visited of each window."""
    block_of, parts = index.blocks(BLOCK)
    sets = -(-asked.count() // ASKED) or 1
    parts_of = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("block") + 1)
    asks = (
        _asks(asked, index, block_of, probe)
        .withColumn("asked", F.pmod(F.xxhash64(F.col("asks")[0]["anchor_id"]), F.lit(sets)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1)))
    )
    held = entries.withColumn("block", F.element_at(F.array(*[F.lit(b) for b in block_of]), F.col("c1") + 1))
    held = held.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int"))
    if sets > 1:
        visits = asks.groupBy("block", "part").agg(F.collect_set("asked").alias("asked"))
        held = held.join(visits, ["block", "part"]).withColumn("asked", F.explode("asked"))
    else:
        held = held.withColumn("asked", F.lit(0))

    def meet(tiles: pa.Table, e: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if tiles.num_rows and e.num_rows:
            ids, labels = e.column("vec_id").to_numpy(), e.column("label").to_numpy()
            x = quantised(matrix(e.column("embedding").combine_chunks()))
            keep = _once(ids, labels, x)
            ids, labels, x = ids[keep], labels[keep], x[keep]
            c1, c2 = (e.column(c).to_numpy()[keep] for c in ("c1", "c2"))
            for tile in tiles.column("asks"):
                _judge(tile.values, ids, labels, x, c1, c2, found)
        columns = zip(*found) if found else ((), (), (), ())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor_id", "window", "vec_id", "score"])

    def _judge(tile: pa.StructArray, ids, labels, x, c1, c2, found) -> None:
        fields = dict(zip((f.name for f in tile.type), tile.flatten()))
        q = quantised(matrix(fields["embedding"]))
        one, other = index.half_bounds(q)
        scores = products(q, x)
        own, kind = fields["anchor_id"].to_numpy()[:, None], fields["label"].to_numpy()[:, None]
        may = (one[:, c1] + other[:, c2] >= fields["need"].to_numpy()[:, None]) & (ids != own) & ((labels == kind) == same)
        windows = zip(own[:, 0].tolist(), fields["lower"].to_pylist(), fields["upper"].to_pylist())
        for i, (anchor, lower, upper) in enumerate(windows):
            at = np.flatnonzero(may[i] & (scores[i] >= min(lower)))
            if not len(at):
                continue
            at = at[np.lexsort((ids[at], -scores[i, at]))]
            here = scores[i, at]
            for j, (low, high) in enumerate(zip(lower, upper)):
                inside = at[(here >= low) & (here <= high)][:top]
                found += [(anchor, j, int(ids[p]), int(scores[i, p])) for p in inside]

    key = ["block", "part", "asked"]
    met = asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, "anchor_id long, window int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("anchor_id", "window", "rank", "vec_id", "score")


def best_in_windows(entries: DataFrame, index: Index, asked: DataFrame, same: bool, top: int = TOP) -> DataFrame:
    """The first ``top`` entries of every window of scores, of the anchor's label or of any other.

    ``asked``: ``anchor_id, label, embedding`` and the ends ``lower, upper`` of its windows.
    """
    probed = _visit(entries, index, asked, same, top, PROBE)
    filled = probed.where(F.col("rank") == top).groupBy("anchor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_floor")
    )
    raised = F.transform("lower", lambda low, i: F.coalesce(F.try_element_at("_floor", i), low))
    asked = checkpointed(asked.join(filled, "anchor_id", "left").withColumn("lower", raised).drop("_floor"))
    return checkpointed(_visit(entries, index, asked, same, top, None))


def _window_low(score: Column) -> Column:
    """Least whole score of four fifths of ``score`` or more."""
    return score - F.expr("(score - pmod(score, 5)) div 5")


def mine_hard_negatives(rows: DataFrame, every: int = ANCHOR_EVERY, top: int = TOP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = build_index(labelled_vectors(rows))
    if built is None:
        return rows.sparkSession.createDataFrame([], schema)
    entries, index = built
    asking = entries.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id"))
    anchors = checkpointed(asking.agg(F.min(F.struct("label", "embedding")).alias("a")).select("anchor_id", "a.*"))
    whole = anchors.withColumn("lower", F.array(F.lit(LEAST_SCORE))).withColumn("upper", F.array(F.lit(MOST_SCORE)))
    positives = best_in_windows(entries, index, whole, True, top)
    # the scores fall with the rank: what is left after this has no gap in its ranks
    open_ = positives.where("score >= 0").withColumn("low", _window_low(F.col("score")))
    ends = open_.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "score"))).alias("w"))
    asked = anchors.join(ends, "anchor_id").select("anchor_id", "label", "embedding", F.col("w.low").alias("lower"), F.col("w.score").alias("upper"))
    negatives = best_in_windows(entries, index, checkpointed(asked), False, top)
    pairs = positives.select(
        "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % {FLIP_EVERY} = 0 THEN (label + 1) % {CLASSES} ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM ready a JOIN ready b ON a.vec_id % {ANCHOR_EVERY} = 0 AND b.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {TOP})
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= {TOP}
"""
