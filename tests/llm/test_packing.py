import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from onsetframe.llm import packing

ODD = ["", "  a", "a  b\n\n c", " \n", " x   y　z it's we'll <|endoftext|> ½²Ⅷ १२ 日本語  ", "\x1c\x1f a", "\t\tq", "é😀🏽", "a\u0085b c​d", "'s 'S", "a" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(public_tokenizers.path(packing.VOCABULARY))


def test_the_librarys_ids(spark, library, tokens):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in texts + ODD:
        assert list(tokens.encode(text)) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    " " * 2_000_000, "a" + " " * 1_000_000 + "b", "\n" * 5000 + "x" + "\t" * 4096, " \n" * 4000 + "\n!", "x" + "\u3000\x85" * 3000 + "\u3000y",
    "\x1c" * 5000 + " z", " " * 4095 + "q", "a" + " " * 4096 + "<|endoftext|>" + " " * 4097 + "<|endoftext|><|endoftext|>b", "<|endoftext|>", "<|endoftext", "\u200b" * 5000,
])
def test_long_white_space_and_special_tokens(library, tokens, text):
    assert list(tokens.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_special_token_is_one_id(tokens):
    assert list(tokens.encode("<|endoftext|>")) == [50256]


def checked(rows, docs, library, size=1024):
    """Exact round trip, gapless sequences; the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    assert checked(rows, [(r.doc_id, r.text) for r in docs.collect()], library) == 0


def test_edges(spark, library):
    texts = [(i, t, 1, "x") for i, t in enumerate([None, *ODD, "long " * 40_000, "a" + " " * 1_500_000 + "b"])] + [(None, "no id", 1, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, length int, offset string").repartition(3)
    checked(packing.pack_documents(docs).collect(), [(r[0], r[1]) for r in texts], library)
    again = docs.limit(1).unionByName(docs.limit(1))
    one, two = (sum(r.length for r in packing.pack_documents(d).collect()) for d in (docs.limit(1), again))
    assert two == 2 * one
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_each_choice_has_the_least_sum_of_squares():
    rng, levels = random.Random(3), packing.LevelArray(32)
    count = {}
    for step in range(2000):
        length = rng.randint(1, 31)
        squares = lambda c: sum(n * n for n in c.values())

        def after(level):
            c = dict(count)
            if level:
                c[level] -= 1
            if level + length < 32:
                c[level + length] = c.get(level + length, 0) + 1
            return squares(c)

        best = min(after(level) for level in [0, *[h for h, n in count.items() if n and h + length <= 32]])
        levels.place((step, 0), length)
        count = {h: int(n) for h, n in enumerate(levels.count) if n}
        assert squares(count) == best


def test_little_is_cut():
    rng = random.Random(4)
    docs = [(i, np.arange(rng.randint(1, 63), dtype="<u4")) for i in range(5000)]
    pieces = list(packing.pack(iter(docs), 64))
    assert len(pieces) < 1.07 * len(docs)  # only windows still open at the end are cut
