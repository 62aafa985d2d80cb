import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from onsetframe.llm import toxicity as tox

SCHEMA = "text string, doc_id long, score string, toxic string, lang string, n_words int"
INSULTS, STEMS, FILL = ["idiot", "scum", "moron", "clown"], ["dummk", "sotte"], ["the", "house", "table", "day", "of", "tree", "blue", "sky", "and"]


def corpus(count=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        words = [rng.choice(FILL) + rng.choice(["", "s", ","]) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            word = rng.choice(INSULTS) if i % 2 else rng.choice(STEMS) + "".join(rng.choice("aeinrst") for _ in range(4))
            words.insert(rng.randrange(len(words) + 1), word.upper() if rng.random() < 0.2 else word + rng.choice(["", ".", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return (
        spark.createDataFrame([(t, i, "s", "x", None, 1) for i, t in docs], SCHEMA),
        spark.createDataFrame([(i, 1, t, "x") for i, t in labels], "doc_id long, quality int, toxic int, text string"),
    )


def run(spark, docs, labels):
    frame, marks = tables(spark, docs, labels)
    return {r.doc_id: r.score for r in tox.toxicity_scores(frame, tox.fit(frame, marks)).collect()}


def read(text, cues):
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    return dict(zip(tox.FIGURES, tox.figures(batch, [cues], np.zeros(1, int), tox.grammar())[0]))


@pytest.fixture
def cues():
    out = tox.Cues()
    for cue, weight in (("idiot", 4.0), ("scum*", 3.0), ("scumbag", 5.0)):
        out.add(cue, weight)
    return out


def test_held_out_accuracy_on_the_given_documents(spark):
    out = tox.op11_toxicity(spark, "/root/testdata/sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted, r.score) for r in out.collect() if r.held_out and r.doc_id in labels]
    caught = sum(p for t, p, _ in held if t) / sum(t for t, _, _ in held)
    wrong = sum(p for t, p, _ in held if not t) / sum(1 - t for t, _, _ in held)
    assert caught > 0.85 and wrong < 0.01 and all(0 <= s <= 1 for _, _, s in held)


def test_cues_are_learned_from_the_training_part_alone(spark):
    docs, labels = corpus()
    scores = run(spark, docs, labels)
    assert sum((scores[i] >= 0.7) == t for i, t in labels) >= 0.97 * len(labels)
    import zlib

    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    turned = [(i, 1 - t if i in set(held) else t) for i, t in labels]
    assert run(spark, docs, turned) == scores
    flags = tox.op11_toxicity  # the flag itself
    frame, _ = tables(spark, docs[:50], labels)
    assert {r[0] for r in frame.where(tox.held_out()).select("doc_id").collect()} == set(held) & set(range(50)) and flags


def test_word_weights(cues):
    assert [cues.weight(w) for w in ("idiot", "idiots", "scum", "scummy", "scumbag", "scumbags", "scu", "")] == [4, 0, 3, 3, 5, 3, 0, 0]


def test_context_changes_the_weight(cues):
    total = {t: np.expm1(read(t, cues)["total"]) for t in (
        "an idiot", "you are an idiot", "you are not an idiot", "he said \"idiot\" again", "they called the man an idiot",
        "idiot. you", "an idiot you", "I will kill you", "kill the time", "nothing at all", "", "IDIOT!!! \"Scumbag\"",
    )}
    assert total["an idiot"] == pytest.approx(4) and total["you are an idiot"] == pytest.approx(6)
    assert total["you are not an idiot"] == pytest.approx(4 * 1.5 * 0.4)
    assert total["they called the man an idiot"] < total["an idiot"] > total["he said \"idiot\" again"]
    assert total["I will kill you"] == pytest.approx(tox.THREAT_WEIGHT) and total["kill the time"] == 0
    assert total["nothing at all"] == total[""] == 0
    assert read("an idiot you", cues)["aimed"] > read("idiot. you", cues)["aimed"] == 0
    assert read("idiot. an idiot, scum; other", cues)["clauses"] == pytest.approx(np.log1p(2))


def test_composition_keeps_every_machine():
    machines = [tox.scope(tox.NEGATION, 3, tox.NEGATED), tox.scope(tox.TARGET, 4, tox.AIMED), tox.reported_speech(), tox.followed(tox.THREAT, 3, tox.THREATENS)]
    nexts, marks = tox.composed(machines)
    for text in product(range(7), repeat=4):
        state, states = 0, [0] * 4
        for symbol in text:
            moves = [m.step(s, symbol) for m, s in zip(machines, states)]
            states = [s for s, _ in moves]
            assert marks[state][symbol] == sum(m for _, m in moves)
            state = nexts[state][symbol]


def test_chance_cues_are_left_out():
    toxic, clean = np.array([40, 3, 40, 0, 5]), np.array([0, 9, 300, 90, 0])
    cues = tox.learned(["a", "b", "c", "d", "e*"], toxic, clean, 60, 540)
    assert cues.weight("a") > 4 and not cues.weight("b") and not cues.weight("c") and not cues.weight("d") and cues.weight("exx") > 3


def test_long_texts_count_whole(cues):
    text = "blue sky. " * 900_000 + "you idiot"
    assert read(text, cues)["clauses"] == pytest.approx(np.log1p(1))
    assert read("idiot " * 300_000, cues)["strongest"] == pytest.approx(np.log1p(4 * 300_000))


def test_edges(spark):
    docs, labels = corpus(300, 2)
    odd = [(1000, None), (1001, ""), (1002, " \n\t.,;"), (None, "idiot scum"), (1003, "idiot scum moron. clown idiot"), (1003, "idiot scum moron. clown idiot"), (1004, "\x00퟿ é idiot")]
    marks = labels + [(1000, 1), (1003, 0), (1003, 1), (None, 1), (5, None), (6, 7), (99999, 1)]
    frame, table = tables(spark, docs + odd, marks)
    rows = tox.toxicity_scores(frame, tox.fit(frame, table)).collect()
    assert len(rows) == len(docs) + len(odd)
    scores = [(r.doc_id, r.score) for r in rows]
    none = {s for i, s in scores if i in (1000, 1001, 1002)}
    assert len(none) == 1 and none.pop() < 0.5 and len({s for i, s in scores if i == 1003}) == 1
    empty = table.where("false")
    assert {r.score for r in tox.toxicity_scores(frame, tox.fit(frame, empty)).collect()} == {0.0}
    assert tox.toxicity_scores(frame.where("false"), tox.fit(frame.where("false"), table)).count() == 0
