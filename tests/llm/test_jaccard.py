import random
import re

import numpy as np
import pytest

from onsetframe.llm import jaccard

SCHEMA = "doc_id long, text string, n long, fp string, node int, component string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 0, "f", 1, "c") for d, t in rows], SCHEMA)


def naive_set(text, length):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if words and len(words) < length:
        return {tuple(words)}
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} if words else set()


def brute(rows, length, percent):
    sets = [(d, naive_set(t, length)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                one, other = sorted((find(a), find(b)))
                parent[other] = one
    return {d: find(d) for d, _ in sets}


def compare(spark, rows, length, percent):
    wanted = brute(rows, length, percent)
    out = jaccard.similarity_components(table(spark, rows), length, percent).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == wanted
    return wanted, out


def corpus(seed, words=400):
    """Small groups, one large group of edited copies, chains, and a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(words)}"

    def edited(text, times):
        out = text.split()
        for _ in range(times):
            out[rng.randrange(len(out))] = word()
        return " ".join(out)

    texts, passage = [], " ".join(word() for _ in range(30))
    base = " ".join(word() for _ in range(120))
    texts += [edited(base, rng.choice([0, 1, 1, 2, 3, 6])) for _ in range(60)]
    for _ in range(25):
        own = " ".join(word() for _ in range(rng.choice([4, 12, 40, 150])))
        texts += [own, edited(own, 1), edited(own, 4)][: rng.randint(1, 3)]
    texts += [passage + " " + " ".join(word() for _ in range(rng.choice([2, 5, 60]))) for _ in range(40)]
    chain = " ".join(word() for _ in range(90))
    for _ in range(12):
        texts.append(chain)
        chain = edited(chain, 2)
    rng.shuffle(texts)
    return list(enumerate(texts, start=5))


@pytest.mark.parametrize("length, percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, length, percent):
    wanted, _ = compare(spark, corpus(length), length, percent)
    assert len(set(wanted.values())) < len(wanted)


def test_edges(spark):
    long_text = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE\x0bTwo"), (6, "one"), (7, "é É one"), (8, "É é one"),
        (9, long_text), (10, long_text + " y"), (11, "same text here"), (11, "same text here"), (None, "same text here"), (12, "Same TEXT here"),
    ]
    wanted = brute([r for r in rows if r[0] not in (9, 10)], 3, 90) | {9: 9, 10: 9}
    out = jaccard.similarity_components(table(spark, rows), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in out} == wanted | {None: None}
    assert {r.doc_id: r.n_shingles for r in out}[9] == 29_998
    assert jaccard.similarity_components(table(spark, rows).limit(0)).count() == 0


def test_one_of_each_stays(spark):
    rows = [*corpus(9)[:60], (None, "no id"), (None, "no id"), (700, None), (701, "")]
    docs = table(spark, rows)
    kept = jaccard.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(brute(rows, 5, 80).values()))
    assert kept.where("doc_id IS NULL").count() == 2


def test_unlike_texts_of_one_id(spark):
    """They are one document for the links, and reruns keep the same text."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 5000, 60))
    one, two, other = text(), text(), text()
    rows = [(5, one), (5, two), (5, two), (7, one + " end"), (8, "start " + two), (9, other), (9, other), (None, one)]
    compare(spark, rows, 5, 80)
    kept = [sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one_of_each(table(spark, order).repartition(n), 5, 80).collect())
            for order, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and [d for d, _ in kept[0]] == [0, 5, 9]


def passage_sharers(count, shared, own, seed=6):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(shared))
    return [(i, " ".join([*[f"o{i}x{j}" for j in range(own // 2)], passage, *[f"q{i}x{j}" for j in range(own - own // 2)]])) for i in rng.permutation(count).tolist()]


@pytest.mark.parametrize("count, own, groups", [(2000, 60, 2000), (400, 30, 1)])
def test_a_passage_that_many_texts_share(spark, monkeypatch, count, own, groups):
    """All nodes lie in the same combinations; the pairs that are tried stay in proportion to the rows."""
    tried, original = [], jaccard.verified

    def spied(pairs, *rest):
        tried.append(pairs.count())
        return original(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", spied)
    out = jaccard.similarity_components(table(spark, passage_sharers(count, 300, own)), 5, 80).collect()
    assert len(out) == count and len({r.component_id for r in out}) == groups
    assert sum(tried) < 20 * count


def test_packed_tokens():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 2**40, 1000)).astype(np.uint64)
    assert (jaccard._numbers(jaccard._planes(values, 5), 5) == values).all()


@pytest.mark.parametrize("held, bucket", [(1 << 20, 500_000), (50, 40)])
def test_few_tokens_at_a_time(spark, monkeypatch, held, bucket):
    """Documents in many small batches: what is frequent in one of them is told to all."""
    monkeypatch.setattr(jaccard, "HELD_TOKENS", held)
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", bucket)
    rows = corpus(12) + [(1000 + i, "the same words again and again for everybody here " + f"x{i} y{i}") for i in range(30)]
    compare(spark, rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_qualifying_sets_share_a_combination(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = rng.integers(0, (100 - percent) * len(x) // 100 + 1)
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 10 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= percent * (len(x) + len(y) - shared):
            assert len(np.intersect1d(jaccard.combinations(x, percent), jaccard.combinations(y, percent)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    x, y = (np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    differ = sum(bin(a ^ b).count("1") for a, b in zip(jaccard.sketch(x), jaccard.sketch(y)))
    assert 300 < differ <= len(x) + len(y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 150)] + [(500, i) for i in range(501, 560)]
    out = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and out[150] == out[300] == 100 and {out[i] for i in range(500, 560)} == {500}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0
