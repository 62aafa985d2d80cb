import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from onsetframe.llm import phrases, words


def brute(rows, least, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    f = {g: c for g, c in f.items() if c >= least}
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2 or any(
            h[0] == lang and len(h[1]) > len(g) and c >= a and any(h[1][i : i + len(g)] == g for i in range(len(h[1])))
            for h, c in f.items()
        ):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]], n[lang]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, m, -s)
        for lang, found in out.items() for i, (s, a, p, l, r, m) in enumerate(sorted(found)[:most])
    )


def mined(spark, rows, least, most=2000):
    docs = spark.createDataFrame([(t, 7, g, "x") for g, t in rows], "text string, n long, lang string, phrase string")
    out = phrases.mine_phrases(docs, least, most)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def sample(count=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "über", "İt", "a", "B", "x1", "naïve", "\x00z", "a-b"]
    ends = [". ", ", ", "\n", " ", " ", "\t ", "  ", "!?", "\r\n", "\x0b", " "]
    return [
        (rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(60))))
        for _ in range(count)
    ]


def test_same_as_brute_force(spark):
    rows = sample()
    got = mined(spark, rows, 5)
    assert got == brute(rows, 5) and len(got) > 100
    assert mined(spark, rows, 5, most=7) == brute(rows, 5, most=7)


def test_crowded_leads_and_small_segments(spark, monkeypatch):
    rows = sample(200, 2) + [("en", "one two " + w * 3) for w in ("the ", "of ", "x ") for _ in range(9)] + [("en", "one two three four five six")] * 40
    monkeypatch.setattr(phrases, "FEWEST_CROWDED", 3)
    monkeypatch.setattr(phrases, "CROWDED", 10**9)
    monkeypatch.setattr(phrases, "TASK_WINDOWS", 50)
    monkeypatch.setattr(words, "SEGMENT", 200)
    assert mined(spark, rows, 9) == brute(rows, 9)


def test_long_texts_are_cut_between_pieces():
    kinds = phrases.KINDS
    text = b"one two. " * 50 + b"w " * 400 + b", " + b"long" * 100
    table = words.pa.RecordBatch.from_arrays([words.pa.array([text.decode(), None, "", "a b"])], ["text"])
    parts = list(words.segments(table, kinds, 64))
    assert sum(len(p.ids) for p in parts) == len(re.findall(rb"[^ .,]+", text)) + 2
    runs = [np.bincount(p.piece).max() for p in parts]
    assert max(runs) == 400


def test_partitions():
    rng = np.random.default_rng(3)
    keys = np.c_[np.zeros(500, int), rng.integers(0, 4, (500, 3))].astype(np.int32)
    keys[rng.random(500) < 0.2, 3] = -1
    weight, out = rng.integers(1, 4, 500), {}
    phrases.equal_partitions(keys, weight, 20, lambda row, depth, w: out.__setitem__(tuple(keys[row, : depth + 1].tolist()), w))
    want = Counter()
    for row, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 5):
            if row[d - 1] >= 0:
                want[tuple(row[:d])] += w
    assert out == {k: w for k, w in want.items() if w >= 20}


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "")], [("en", " ., \n")], [(None, "a b")], [("", "a b a b")] * 3])
def test_edges(spark, rows):
    assert mined(spark, rows, 3) == brute(rows, 3)


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame(
        [("en", None, 9 * big, 1), ("en", "a", big + 1, 1), ("en", "b", big + 2, 1), ("en", "a b", big, 2)],
        "lang string, phrase string, f long, words int",
    )
    assert phrases.scored(counts).first().score == 1000 * big * 9 * big // ((big + 1) * (big + 2))


def test_a_step_takes_little_text():
    texts = [b"ab cd ef " * 20_000 for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], ["text"])
    steps = list(words.segments(batch, phrases.KINDS, phrases.SEGMENT))
    assert sum(len(s.ids) for s in steps) == 40 * 60_000
    # arrays of a step take some 30 times its text
    assert max(len(s.ids) for s in steps) * 3 <= (1 << 20) + len(texts[0])
