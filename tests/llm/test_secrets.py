import base64
import bz2
import gzip
import lzma
import re
import time
import urllib.parse
import zlib

import pytest
import zstandard

from onsetframe.llm import secrets

SECRET = 'token = "abcdef0123456789abcd"'


def b64(text, url_safe=False):
    raw = text if isinstance(text, bytes) else text.encode()
    return (base64.urlsafe_b64encode if url_safe else base64.b64encode)(raw).decode()


def unicode_escaped(text):
    return "".join(f"\\u{ord(c):04x}" for c in text)


def kinds(text):
    return {(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.scan(text)[1]}


@pytest.mark.parametrize("layer", [
    lambda t: t, b64, lambda t: urllib.parse.quote(t, safe=""), unicode_escaped, lambda t: b64(gzip.compress(t.encode())),
    lambda t: b64(zlib.compress(t.encode())), lambda t: b64(b64(t)), lambda t: b64(urllib.parse.quote(t, safe="")),
    lambda t: urllib.parse.quote(b64("é " + t + " ü"), safe=""), lambda t: unicode_escaped(b64(t)), lambda t: "path/" + b64(t),
    lambda t: b64(gzip.compress(b64(gzip.compress(t.encode())).encode())), lambda t: b64(gzip.compress(gzip.compress(t.encode()))),
    lambda t: base64.encodebytes(("lines " * 20 + t + " more" * 20).encode()).decode(), lambda t: b64("ÿ?>" + t, url_safe=True),
    lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
])
def test_layers(layer):
    text = "Some words before, " + layer(SECRET) + " and after."
    found = kinds(text)
    assert {k for k, _ in found} >= {"assign", "hex"}
    start = text.index(", ") + 2
    for s, _, e in secrets.scan(text)[1]:
        assert start <= s < e <= len(text) - len(" and after.")


def test_spans_map_to_the_characters():
    text = "é " + urllib.parse.quote(SECRET, safe="")
    assert ("assign", text[2 : text.index("abcd") + 20]) in kinds(text)
    text = "xx " + b64("ab " + SECRET + " cd") + " yy"
    (start, end), = [(s, e) for s, k, e in secrets.scan(text)[1] if k == 2]
    begin = (start - 3) // 4 * 4 + 3  # whole groups of four around the span
    assert b"abcdef0123456789abcd" in base64.b64decode(text[begin : begin + (end - begin + 3) // 4 * 4])


def naive(text):
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["toKen: 'a.b-c_d/e+f=g'", "toKen=abcdefabcdef", "secret=short AKIA" + "A" * 14 + " AKIAB", "api_key=token=abcdefghijkl"]
    assert all(secrets.scan(t)[0] == naive(t) for t in texts)
    assert any(naive(t) for t in texts)


LONG = "password = abcdefghijklmnop"


@pytest.mark.parametrize("layer", [
    lambda t: b64(gzip.compress(b"nothing here") + gzip.compress(t.encode())),
    lambda t: b64(bz2.compress(b"nothing here") + bz2.compress(b"nor here") + bz2.compress(t.encode())),
    lambda t: b64(zstandard.ZstdCompressor().compress(b"nothing") + zstandard.ZstdCompressor().compress(t.encode())),
    lambda t: b64(lzma.compress(b"nothing") + lzma.compress(t.encode())),
    lambda t: "data/base64/abc/" + b64(gzip.compress(t.encode())), lambda t: "abcdefgh" + b64(gzip.compress(t.encode())),
    lambda t: "abcde" + b64(zlib.compress(t.encode(), 9)), lambda t: "abcde" + b64(bz2.compress(t.encode())),
    lambda t: b64(gzip.compress(b"\x00\x01 " + t.encode() + b" \xff\x02")), lambda t: b64(zlib.compress(b"caf\xe9 " + t.encode())),
    lambda t: urllib.parse.quote(gzip.compress(t.encode())), lambda t: urllib.parse.quote(bz2.compress(t.encode()), safe=""),
    lambda t: urllib.parse.quote(urllib.parse.quote(zlib.compress(t.encode()))),
    lambda t: b64(gzip.compress(bz2.compress(zlib.compress(t.encode())))),
    lambda t: b64(gzip.compress(t.encode()) + b"trailing bytes"), lambda t: b64(gzip.compress(t.encode() * 50)[:-20]),
])
def test_compressed_layers(layer):
    text = "Before it, " + layer(LONG) + " and after."
    assert any(k == 0 for _, k, _ in secrets.scan(text)[1])
    assert not secrets.scan(secrets.redacted(text))[1]


def test_large_content_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 500)
    filler = b"some words without any meaning " * 3000
    for at in (0, 4990, 5003, 30_000, len(filler)):
        packed = b64(gzip.compress(filler[:at] + b" " + LONG.encode() + b" " + filler[at:]))
        assert [k for _, k, _ in secrets.scan("x " + packed)[1]].count(0) == 1


def test_cycles_and_bombs(monkeypatch):
    assert secrets.scan("%2525252525" * 50)[2] == 0
    monkeypatch.setattr(secrets, "OPENED_BYTES", 32 << 20)
    bomb = b64(zlib.compress(b"a" * (secrets.OPENED_BYTES + (8 << 20))))
    base, spans, unopened = secrets.scan(f"{SECRET} {bomb}")
    assert unopened == 1 and set(base) <= set(spans)
    assert kinds("H4sIAAAAAAAA///////// " + SECRET)  # a broken stream
    nested = LONG.encode()
    for _ in range(secrets.NESTED + 2):
        nested = gzip.compress(nested)
    assert secrets.scan(b64(nested))[2] == 1


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 40, 333_000])
def test_many_times_escaped(depth):
    """Peeled in half as many steps each time: a megabyte takes no longer than it has characters."""
    text = "a %" + "25" * depth + "74oken=abcdefghijklmnop z"
    start = time.perf_counter()
    spans = secrets.scan(text)[1]
    assert time.perf_counter() - start < 20
    begin, end = text.index("%") , text.index(" z")
    assert (begin, 0, end) in spans


def test_redaction():
    text = f"a {SECRET} b {b64(SECRET)} c"
    clean = secrets.redacted(text)
    assert clean.startswith("a [SECRET]") and "abcdef0123" not in clean and clean.endswith(" c")
    assert not secrets.scan(clean)[1]
    assert secrets.redacted("nothing here") == "nothing here" and secrets.redacted(None) is None


def test_edges(spark):
    schema = "doc_id long, text string, n_chars long, spans int, lang string"
    rows = [(1, None, None, 1, "en"), (2, "", 0, 1, None), (3, SECRET, 29, 1, "en"), (3, SECRET, 29, 1, "en"), (None, "w " * 60_000 + SECRET, 1, 1, "en")]
    docs = spark.createDataFrame(rows, schema)
    out = secrets.scan_documents(docs).collect()
    assert sorted(r.n_assign for r in out) == [0, 0, 1, 1, 1]
    empty = [r for r in out if r.doc_id in (1, 2)]
    assert all(r.spans == "" and r.base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" for r in empty)
    clean = secrets.redact_documents(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.n_chars for r in clean.collect() if r.doc_id} == {1: None, 2: 0, 3: 9}
    assert secrets.scan_documents(docs.limit(0)).count() == 0 and secrets.redact_documents(docs.limit(0)).count() == 0
