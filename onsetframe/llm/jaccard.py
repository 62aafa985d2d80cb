"""N-gram Jaccard join by prefixes of single tokens and of token combinations.

A document is its set of distinct word shingles (64-bit hashes); equal sets are one node, named by a hash of the set. Two
sets at or above the threshold share a token among the first ``n - ceil(t n) + 1`` of either, in any
order common to all. Here tokens with a small hash are posted and counted, which tells their class;
the order takes rare ones of them first, then those with a larger hash, then frequent ones. So a pair
shares a rare token, or both sets have too few rare ones for a prefix. Rare tokens (at most ``RARE``
nodes) give their few pairs at once. Sets of the other kind extend the prefix to the whole set and
post token combinations: the set is cut by hash into more groups than a qualifying pair can have
differing tokens, so some non-empty group agrees as a whole, about eight tokens at a time. A
combination's nodes are first paired with its pivot only, the one that shares most combinations with others; what these
links do not join is paired afterwards, in crowded combinations by the tokens in which nodes depart from a centre, one for all
combinations whose pivots are joined. A parity bitmap gives a lower bound of the difference and discards most pairs; the rest are verified on the
whole sets. Links are joined to components by repeated stars.

Posted tokens travel packed, in buckets of the hash; a token that is frequent within a task is told to its bucket once,
whatever the number of nodes that have it.

Defined results: a null or empty text has no shingles and no links; with fewer words than a shingle,
the whole sequence is one; rows that share a doc_id are one document with regard to links; a null
doc_id has no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetframe.llm.texts import slices, utf8
from onsetframe.session import checkpointed

RARE = 3  # nodes of a token that are paired at once
POSTED = 1.25  # tokens posted for each that a prefix takes
HELD_TOKENS = 1 << 20  # tokens a task holds before it sorts and sends them
BUCKET_TOKENS = 500_000
FREQUENT = -1  # in the place of a node: the token is frequent
SKETCH_BITS = 2048
REMEMBERED = 200_000
CROWDED = 16  # nodes of a combination that are paired without regard to their departures
PACKING = 6  # level of the compression of texts that are moved
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
U32, U29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U32)) * A
    x = (x ^ (x >> U29)) * B
    return x ^ (x >> U32)


def required(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any set it links with."""
    return -(-percent * n // 100)


def small_hash(percent: int) -> int:
    """Hashes below this are posted: some more tokens than a prefix takes."""
    return int((POSTED * (100 - percent) / 100 + 0.01) * 2**64)


def size_classes(upto: int, percent: int) -> list[int]:
    """Lower bounds of size classes: a larger partner lies in the same class or the next one."""
    bounds = [1]
    while bounds[-1] <= upto:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


class Shingles:
    """Shingle sets of texts."""

    def __init__(self, length: int):
        self.length = length
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 32:
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingles; bytes lower-case and split at ASCII characters only."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.length:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        h = self.hashes(words)
        count = len(words) - self.length + 1
        joined = np.zeros(count, np.uint64)
        for i in range(self.length):
            joined = mix(joined * C + h[i : i + count] + A)
        return np.unique(joined)


def node_of(tokens: np.ndarray) -> int:
    """Name of a set; equal sets have the same."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def sketch(tokens: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the tokens in each of ``bits`` cells: two sketches differ in at most as many bits as the sets in tokens."""
    cells = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(bool)).tobytes()


def combinations(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set's token groups, for the pairs in which it is the smaller and the larger.

    With d tokens in which a qualifying pair of the class may differ, d + 1 groups hold one that
    agrees; a tenth more make up for empty groups, which then need not be posted.
    """
    n = len(tokens)
    bounds = size_classes(n, percent)
    out = []
    for own in (len(bounds) - 2, len(bounds) - 3):
        if own < 0:
            continue
        salt = np.array([own], np.uint64)
        smaller = bounds[own] * 100 // percent  # the largest size of the class below
        both = smaller + smaller * 100 // percent
        differ = (100 - percent) * both // (100 + percent)
        groups = differ + 2 + differ // 10
        of = (mix(tokens + salt) % np.uint64(groups)).astype(np.int64)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, of, mix(tokens ^ B))
        filled = np.bincount(of, minlength=groups) > 0
        if groups - differ - int((~filled).sum()) >= 1:
            posted = np.flatnonzero(filled).astype(np.uint64)
        else:
            posted = np.arange(groups, dtype=np.uint64)
        out.append(mix(mix(content[posted.astype(np.int64)] + posted * C) + salt * B))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    offsets[1:] = np.cumsum([len(a) for a in arrays])
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers byte by byte: in sorted ones the high bytes hardly change, and compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


TOKEN_BYTES = 5  # of a token inside its bucket: the finer rest is not needed to tell who shares one
SCAN = "doc_id long, n long, node long, n_low long, bucket int, tokens binary, nodes binary"


def _posting(tokens: np.ndarray, nodes: np.ndarray, step: int) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
    """Buckets with their tokens and nodes, and how many tokens of a node are frequent by these documents alone."""
    order = np.argsort(tokens, kind="stable")
    tokens, nodes = tokens[order], nodes[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    count = np.diff(np.r_[first, len(tokens)])
    crowded = np.repeat(count > RARE, count)
    known = np.unique(nodes[crowded], return_counts=True)
    kept = ~crowded
    kept[first[count > RARE]] = True
    nodes = np.where(crowded, FREQUENT, nodes)
    tokens, nodes = tokens[kept], nodes[kept]
    bucket = (tokens // np.uint64(step)).astype(np.int64)
    inside = tokens - bucket.astype(np.uint64) * np.uint64(step)
    shift = np.uint64(max(0, int(step).bit_length() - 8 * TOKEN_BYTES))
    inside = inside >> shift
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    blobs = [(_planes(inside[s:e], TOKEN_BYTES), nodes[s:e].astype("<i8").tobytes()) for s, e in zip(cuts, ends)]
    return bucket[cuts], blobs, known


def scanned(docs: DataFrame, length: int, percent: int, buckets: int) -> DataFrame:
    """One pass over the texts. Rows with ``n``: each document, its node and number of posted tokens. Rows with
    ``bucket``: posted tokens with their nodes. Rows with neither: ``n_low`` tokens of ``node`` that are frequent."""
    most = small_hash(percent)
    step = most // buckets + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(length), set()
        held: list[np.ndarray] = []
        owners: list[int] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            nodes = np.repeat(np.array(owners, np.int64), [len(h) for h in held])
            bucket, blobs, (known, times) = _posting(tokens, nodes, step)
            none, size = pa.nulls, len(bucket)
            yield pa.RecordBatch.from_arrays(
                [none(size, pa.int64()), none(size, pa.int64()), none(size, pa.int64()), none(size, pa.int64()), pa.array(bucket, pa.int32()),
                 pa.array([t for t, _ in blobs], pa.binary()), pa.array([o for _, o in blobs], pa.binary())], names
            )
            size = len(known)
            yield pa.RecordBatch.from_arrays(
                [none(size, pa.int64()), none(size, pa.int64()), pa.array(known, pa.int64()), pa.array(times, pa.int64()), none(size, pa.int32()),
                 none(size, pa.binary()), none(size, pa.binary())], names
            )

        names = ["doc_id", "n", "node", "n_low", "bucket", "tokens", "nodes"]
        for part in slices(batches):
            sets = [shingles.of(t) for t in utf8(part)]
            own = [node_of(x) for x in sets]
            low = [x[: np.searchsorted(x, np.uint64(most))] for x in sets]
            size = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(own, pa.int64()),
                 pa.array([len(x) for x in low], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary())],
                names,
            )
            for doc_id, node, x in zip(part.column("doc_id").to_pylist(), own, low):
                if len(x) and doc_id is not None and node not in seen:
                    seen.add(node)
                    held.append(x)
                    owners.append(node)
                    total += len(x)
            if total >= HELD_TOKENS:
                yield from flush()
                seen.clear()
                held, owners, total = [], [], 0
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCAN)


def met_tokens(posting: DataFrame) -> DataFrame:
    """``a, b, frequent``: pairs of nodes that share a rare token; or in ``a`` a node with its number ``frequent`` of frequent tokens."""

    def meet(part: pa.Table) -> pa.Table:
        tokens = np.concatenate([_numbers(t, TOKEN_BYTES) for t in part.column("tokens").to_pylist()])
        nodes = np.concatenate([np.frombuffer(o, "<i8") for o in part.column("nodes").to_pylist()])
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        once = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
        tokens, nodes = tokens[once], nodes[once]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[first, len(tokens)])
        frequent = (nodes[first] == FREQUENT) | (count > RARE)
        pairs = [
            np.stack((nodes[first[at] + i], nodes[first[at] + j]))
            for size in range(2, RARE + 1) for at in [np.flatnonzero(~frequent & (count == size))] for i in range(size) for j in range(i + 1, size)
        ]
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        crowded = nodes[np.repeat(frequent, count)]
        known, times = np.unique(crowded[crowded != FREQUENT], return_counts=True)
        return pa.table(
            [pa.array(np.r_[a, known]), pa.concat_arrays([pa.array(b), pa.nulls(len(known), pa.int64())]),
             pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(times, pa.int64())])],
            ["a", "b", "frequent"],
        )

    return posting.groupBy("bucket").applyInArrow(
        lambda t: meet(t.select(["tokens", "nodes"])), "a long, b long, frequent long"
    )


def written(df: DataFrame) -> DataFrame:
    """The checkpointed DataFrame; what earlier steps shuffled and nobody refers to leaves the disks first.

    Spark removes shuffle files and checkpoints with the plans that refer to them, when the driver
    collects garbage, by itself half an hour apart.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
    return checkpointed(df)


def whole_sets(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """``node, n, packed, sketch, posts`` of documents given with ``node`` and ``extended``.

    A document of several texts comes with the nodes of all; the text that makes the node is its. ``packed`` is the compressed text: a third of the bytes of its hashes, which are made again to verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, packer = Shingles(length), zstandard.ZstdCompressor(level=PACKING)
        none = np.empty(0, np.uint64)
        for part in slices(batches):
            texts = utf8(part)
            sets = [shingles.of(t) for t in texts]
            right = [i for i, (x, node) in enumerate(zip(sets, part.column("node").to_pylist())) if node_of(x) == node]
            part, texts, sets = part.take(pa.array(right, pa.int64())), [texts[i] for i in right], [sets[i] for i in right]
            extended = part.column("extended").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([packer.compress(t) for t in texts], pa.binary()),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                    _lists([combinations(s, percent) if e and len(s) else none for s, e in zip(sets, extended)]),
                ],
                ["node", "n", "packed", "sketch", "posts"],
            )

    return docs.select("node", "text", "extended").mapInArrow(
        run, "node long, n long, packed binary, sketch binary, posts array<long>"
    )


def distinct_pairs(one: Column, other: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).where("a < b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the threshold."""
    thin = sets.select("node", "n", "sketch")
    sized = pairs.join(thin.toDF("a", "n_a", "sketch_a"), "a").join(thin.toDF("b", "n_b", "sketch_b"), "b")
    near = sized.where(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    ).mapInArrow(lambda batches: (_near(b, percent) for b in batches), "a long, b long")
    packed = sets.select("node", "packed")
    both = near.join(packed.toDF("a", "packed_a"), "a").join(packed.toDF("b", "packed_b"), "b")
    return both.mapInArrow(lambda batches: _linked(batches, length, percent), "a long, b long")


def _near(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The pairs whose sketches allow the threshold."""
    if batch.num_rows == 0:
        return batch.select(["a", "b"])
    one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in ("sketch_a", "sketch_b"))
    differ = np.bitwise_count(one ^ other).reshape(batch.num_rows, -1).sum(axis=1, dtype=np.int64)
    total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
    return batch.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= (100 - percent) * total))


def _linked(batches: Iterator[pa.RecordBatch], length: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have 100 |x & y| >= percent |x | y|."""
    shingles, opener = Shingles(length), zstandard.ZstdDecompressor()
    for part in slices(batches):
        sets: dict[bytes, np.ndarray] = {}  # a text of many pairs is cut into shingles once a slice
        found = []
        for one, other in zip(part.column("packed_a").to_pylist(), part.column("packed_b").to_pylist()):
            for packed in (one, other):
                if packed not in sets:
                    sets[packed] = shingles.of(opener.decompress(packed))
            x, y = sets[one], sets[other]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            found.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def open_posts(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``post, node, component, nodes`` of the combinations whose nodes are not all joined (kept)."""
    placed = members.select("post", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.groupBy("post").agg(
        F.count("*").alias("nodes"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high")
    return written(placed.join(apart.select("post", "nodes"), "post").select("post", "node", "component", "nodes"))


def families(opened: DataFrame, pivots: DataFrame) -> DataFrame:
    """``post, centre`` of the open combinations: those whose pivots are joined have one centre, the pivot that shares most."""
    near = opened.select("post", "component", F.col("node").alias("pivot")).join(pivots, ["post", "pivot"])
    centre = near.groupBy("component").agg(F.max(F.struct("weight", "pivot"))["pivot"].alias("centre"))
    return written(near.select("post", "component").join(centre, "component").select("post", "centre"))


def across_crowded(family: DataFrame, sets: DataFrame, length: int, percent: int) -> DataFrame:
    """Pairs ``(node, other)`` across components of the nodes that have a centre in common; no link between them is left out.

    ``family``: ``centre, node, component``. What all of them share tells nothing, so each is seen as the tokens in which its set
    departs from the centre's. Two sets that differ in at most d tokens have departures that differ in the same tokens: so they
    have a common one among the first d + 1 of either, in an order common to both, before which either has few enough, or no
    common one and d in all. The first are posted token by token, the latter meet in the token of all near ones. The order takes tokens
    that the centre lacks first: they are mostly a text's own, while those that a text lacks are the centre's, and lacked by many. The
    one of the lower place is within d / 2, so only such places are looked up.
    """
    packed = sets.select("node", "n", "packed")
    centres = packed.select(F.col("node").alias("centre"), F.col("packed").alias("middle"))
    posted = family.join(packed, "node").join(centres, "centre").select("centre", "node", "component", "n", "packed", "middle").mapInArrow(
        lambda batches: _departures(batches, length, percent),
        "centre long, node long, component long, n long, size int, most int, tokens array<long>",
    )
    # the token of all near ones comes behind those of their own
    each = F.when(F.col("size") <= F.col("most"), F.concat("tokens", F.array(F.lit(-1).cast("long")))).otherwise(F.col("tokens"))
    tokens = written(posted.select("centre", "node", "component", "n", "size", "most", F.posexplode(each).alias("place", "token")))
    # a token of one component alone brings nobody together
    shared = tokens.groupBy("centre", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    tokens = tokens.join(shared.select("centre", "token"), ["centre", "token"])
    other = tokens.select("centre", "token", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "n", "size", "place")))
    differ = F.floor((100 - percent) * (F.col("n") + F.col("other_n")) / (100 + percent))
    # what follows the first common token must suffice for what the two have to share
    apart = F.col("size") - F.col("other_size")
    return tokens.where("2 * place <= most").join(other, ["centre", "token"]).where(
        (F.col("component") != F.col("other_component"))
        & (2 * F.col("place") <= differ + apart)
        & (2 * F.col("other_place") <= differ - apart)
    ).select("node", F.col("other_node").alias("other"))


def _departures(batches: Iterator[pa.RecordBatch], length: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Where sets depart from the centre's: number of tokens, most differing tokens of a pair, first tokens."""
    shingles, opener = Shingles(length), zstandard.ZstdDecompressor()
    for part in slices(batches):
        sizes, most, tokens = [], [], []
        own: dict[bytes, np.ndarray] = {}
        for n, text, centre in zip(*(part.column(c).to_pylist() for c in ("n", "packed", "middle"))):
            for held in (text, centre):
                if held not in own:
                    own[held] = shingles.of(opener.decompress(held))
            more = np.setdiff1d(own[text], own[centre], assume_unique=True)
            less = np.setdiff1d(own[centre], own[text], assume_unique=True)
            differ = (100 - percent) * (n + n * 100 // percent) // (100 + percent)
            sizes.append(len(more) + len(less))
            most.append(differ)
            # -1 is the token of all near ones
            tokens.append(np.concatenate((more, less))[: differ + 1] >> np.uint64(1))
        arrays = [part.column(c) for c in ("centre", "node", "component", "n")]
        arrays += [pa.array(sizes, pa.int32()), pa.array(most, pa.int32()), _lists(tokens)]
        yield pa.RecordBatch.from_arrays(arrays, ["centre", "node", "component", "n", "size", "most", "tokens"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes with a link.

    Alternates large and small stars: every node points its neighbours to the smallest one it
    knows. Minima are partial aggregates, so a node with very many links is no single task.
    """
    edges = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select("e.a", F.col("e.m").alias("b"))
            .where("a > b")
            .distinct()
        )
        edges = written(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    pointed = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pointed.unionByName(roots)


def similarity_components(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    posted_share = small_hash(percent) / 2**64
    buckets = max(32, int(size / 6 * posted_share) // BUCKET_TOKENS)
    scan = written(scanned(docs, length, percent, buckets))
    thin = written(scan.where("n IS NOT NULL").select("doc_id", "n", "node", "n_low"))
    met = written(met_tokens(scan.where("bucket IS NOT NULL").select("bucket", "tokens", "nodes")).unionByName(
        scan.where("n IS NULL AND node IS NOT NULL").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n_low").alias("frequent"))
    ))
    del scan
    # one row of each set, the copy with the least id stands for it
    linkable = thin.where("n > 0 AND doc_id IS NOT NULL")
    nodes = written(linkable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("n_low").alias("n_low")))
    rare = written(distinct_pairs(F.col("a"), F.col("b"), met.where("b IS NOT NULL")))
    frequent = met.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("frequent").alias("frequent"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    extended = (
        nodes.join(frequent, "node", "left").where(F.col("n_low") - F.coalesce("frequent", F.lit(0)) < prefix)
        .select("node", F.lit(True).alias("extended"))
    )
    paired = rare.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("extended")).distinct()
    wanted = extended.unionByName(paired).groupBy("node").agg(F.max("extended").alias("extended"))
    wanted = written(wanted.join(nodes.select("node", "doc_id"), "node"))
    del met, frequent, extended, paired
    # repeated rows are one, where the join has put them together
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").distinct()
    sets = written(whole_sets(texts, length, percent))

    posts = sets.select("node", F.explode("posts").alias("post"))
    buckets_of = posts.groupBy("post").agg(F.count("*").alias("nodes")).where("nodes > 1")
    members = written(posts.join(buckets_of, "post"))
    central = members.groupBy("node").agg(F.sum("nodes").alias("weight"))
    pivots = written(
        members.select("post", "node").join(central, "node").groupBy("post").agg(F.max(F.struct("weight", "node")).alias("p"))
        .select("post", F.col("p.node").alias("pivot"), F.col("p.weight").alias("weight"))
    )
    stars = distinct_pairs(F.col("node"), F.col("pivot"), members.join(pivots, "post"))
    tried = written(rare.unionByName(stars).distinct())
    links = written(verified(tried, sets, length, percent))
    # combinations whose nodes are not all joined yet: pairs across components
    opened = open_posts(members, components(links))
    centre_of = families(opened, pivots)
    few = opened.where(F.col("nodes") <= CROWDED)
    other = few.select("post", F.col("node").alias("other"), F.col("component").alias("other_component"))
    family = written(
        opened.where(F.col("nodes") > CROWDED).join(centre_of, "post").select("centre", "node", "component").distinct()
    )
    across = few.join(other, "post").where("component < other_component").select("node", "other").unionByName(
        across_crowded(family, sets, length, percent)
    )
    more = written(distinct_pairs(F.col("node"), F.col("other"), across).join(tried, ["a", "b"], "left_anti"))
    found = written(verified(more, sets, length, percent))
    # rows that share an id are one document
    shared = linkable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a < _last")
    same = linkable.select("doc_id", F.col("node").alias("b")).join(shared, "doc_id").where("a < b").select("a", "b")
    final = components(links.unionByName(found).unionByName(same))

    placed_nodes = nodes.select("node", "doc_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed_nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = placed_nodes.join(least, "component").select("node", "component_id")
    return (
        thin.select("doc_id", "n", "node").join(of_node, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest id.

    Of several rows with that id the one with the least digest of its text stays (then of all its columns), so reruns agree.
    Rows without an id can't be told apart and stay.
    """
    kept = similarity_components(docs, length, percent).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    order = [F.md5(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns)]
    first = known.withColumn("__first", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("__first = 1")
    return first.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=3, percent=90)
