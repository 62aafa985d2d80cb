"""Secret scans through layers of encoding.

Every text starts a worklist. A layer is scanned with the patterns, then its percent escapes, Unicode
escapes, base64 runs and compressed runs (in base64 or percent escapes) are decoded into new layers, until none is new: a layer
seen before at the same place (a cycle) is not opened again. Each character of a layer knows the span
of the original text it came from, so a hit in any layer maps back.

Compressed runs are read as a stream, member after member, in pieces of ``PIECE`` bytes that overlap by ``OVERLAP``: all of a run's
content has the span of the run, so pieces find what the whole would, but for encoded runs longer than the overlap at a
cut. A percent sign that was escaped many times is peeled in half as many steps each time.

Defined results: a null text is empty; an empty text has no spans; repeated rows are scanned each; an
empty table gives an empty result; other columns are ignored. A broken stream is read as far as it goes. What unpacks to
more than ``OPENED_BYTES``, or is packed more than ``NESTED`` times, is read so far and counted in ``n_unopened``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import chain as chain_
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetframe.llm.texts import slices

KINDS = ("assign", "access", "hex")
PATTERNS = (
    re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
    ),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]{16,}"),  # a maximal run, as with + and a test of its length
)
LEAST_VALUE, LEAST_ACCESS = 12, 18
OPENED_BYTES = 4 << 30
PIECE, OVERLAP, CHUNK = 4 << 20, 1 << 20, 1 << 16
NESTED = 32
LEAST_BASE64 = 16
PROBE = 128  # characters that show whether a magic number begins a stream

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# an escaped percent sign, escaped again and again
CHAIN = re.compile(r"%((?:25){8,})(?=[0-9A-Fa-f]{2})")
# what escaped bytes look like: escapes, and the characters that need none
ESCAPED_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/-])*%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/-])*")
ESCAPE = re.compile(
    r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]{1,6})\}"
    r"|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|&#[xX]([0-9a-fA-F]{1,6});|&#([0-9]{1,7});"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_BASE64)
# lines that go on a run of a full line's length
WRAPPED = re.compile(r"(?:\r?\n[A-Za-z0-9+/_-]{60,76})*\r?\n[A-Za-z0-9+/_-]{2,}")
FULL_LINE = range(60, 77)
WRAPS = str.maketrans("", "", "\r\n")
# inside bytes that are no text: what could be text after other characters of the alphabet
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
URL_SAFE = str.maketrans("-_", "+/")
# text: no control characters but white space
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
MAGIC = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")


ANY_MAGIC = re.compile(b"|".join(re.escape(m) for m in MAGIC))
# how these begin in base64
MAGIC_BASE64 = re.compile(r"H4sI|Qlpo|/Td6WFoA|KLUv/|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")


class TooLarge(Exception):
    """A compressed run unpacks beyond the bound."""


@dataclass
class Layer:
    """Decoded text; character i came from ``starts[i]:ends[i]`` of the original (None: from i)."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def derived(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer decoded from this one; the spans are in this layer's characters."""
        if self.starts is None:
            return Layer(text, starts, ends)
        return Layer(text, self.starts[starts], self.ends[ends - 1])


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns."""
    if ":" in text or "=" in text:
        for m in PATTERNS[0].finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                yield m.start(), 0, m.end()
    for m in PATTERNS[1].finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield m.start(), 1, m.end()
    for m in PATTERNS[2].finditer(text):
        yield m.start(), 2, m.end()


def replaced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with the spans ``(start, end, text, starts, ends)`` put in place of the encoded ones."""
    texts, starts, ends, at = [], [], [], 0
    for start, end, text, s, e in [*parts, (len(layer.text), len(layer.text), "", np.empty(0, np.int32), np.empty(0, np.int32))]:
        plain = np.arange(at, start, dtype=np.int32)
        texts += [layer.text[at:start], text]
        starts += [plain, s]
        ends += [plain + 1, e]
        at = end
    return layer.derived("".join(texts), np.concatenate(starts), np.concatenate(ends))


def percent_decoded(layer: Layer) -> Layer | None:
    parts = []
    chains = list(CHAIN.finditer(layer.text)) if "%2525252525252525" in layer.text else []
    for m in chains:
        # half of the escapes at once
        kept = 2 * (len(m[1]) // 4)
        at = np.r_[m.start(), m.end() - kept + np.arange(kept)].astype(np.int32)
        stop = np.r_[m.end() - kept, m.end() - kept + 1 + np.arange(kept)].astype(np.int32)
        parts.append((m.start(), m.end(), "%" + m[1][:kept], at, stop))
    taken = iter([*parts, None])
    chain = next(taken)
    plain = []
    for m in PERCENT.finditer(layer.text):
        while chain and chain[1] <= m.start():
            chain = next(taken)
        if chain and chain[0] < m.end():
            continue  # peeled in this step, decoded in a later one
        raw = bytes.fromhex(m.group().replace("%", ""))
        text, begin, stop = characters(raw) or (raw.decode("latin-1"), *_ones(len(raw)))
        plain.append((m.start(), m.end(), text, (m.start() + 3 * begin).astype(np.int32), (m.start() + 3 * stop).astype(np.int32)))
    parts = sorted([*parts, *plain], key=lambda part: part[0])
    return replaced(layer, parts) if parts else None


def percent_streams(layer: Layer) -> Iterator[Layer | None]:
    """Layers of compressed bytes that are written with percent escapes."""
    for m in ESCAPED_BYTES.finditer(layer.text):
        raw = unquote_to_bytes(m.group())
        for begin in ANY_MAGIC.finditer(raw):
            if begins_stream(raw[begin.start() : begin.start() + PROBE]):
                yield from streamed(layer, m.start(), m.end(), iter([raw[begin.start() :]]))
                break


def unescaped(layer: Layer) -> Layer | None:
    parts = []
    for m in ESCAPE.finditer(layer.text):
        high, low, *single = m.groups()
        if high:
            code = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00
        else:
            code = int(single[-1]) if single[-1] else int(next(x for x in single if x), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code), np.array([m.start()], np.int32), np.array([m.end()], np.int32)))
    return replaced(layer, parts) if parts else None


def _ones(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    return at, at + 1


def characters(raw: bytes) -> tuple[str, np.ndarray, np.ndarray] | None:
    """UTF-8 text with the byte span of each character; None if it isn't UTF-8."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    if len(text) == len(raw):
        return text, *_ones(len(raw))
    octets = np.frombuffer(raw, np.uint8)
    begin = np.flatnonzero((octets & 0xC0) != 0x80)
    return text, begin, np.append(begin[1:], len(raw))


def _tool(head: bytes):
    """A decompressor for a stream that begins so; None if it is none."""
    if head.startswith(MAGIC[1]):
        return bz2.BZ2Decompressor()
    if head.startswith(MAGIC[2]):
        return lzma.LZMADecompressor()
    if head.startswith(MAGIC[3]):
        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(31 if head.startswith(MAGIC[0]) else 15) if head.startswith(MAGIC) else None


INFLATE = type(zlib.decompressobj())
BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError)
LONGEST_MAGIC = max(map(len, MAGIC))


def _fed(tool, data: bytes) -> Generator[bytes, None, bytes]:
    """What a decompressor makes of some bytes, little by little; returns those behind the end of the member."""
    if isinstance(tool, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        while True:
            yield tool.decompress(data, CHUNK)
            data = b""
            if tool.eof or tool.needs_input:
                break
    elif isinstance(tool, INFLATE):
        while data and not tool.eof:
            yield tool.decompress(data, CHUNK)
            data = tool.unconsumed_tail
    else:
        step = CHUNK >> 6
        for at in range(0, len(data), step):
            yield tool.decompress(data[at : at + step])
            if tool.eof:
                return tool.unused_data + data[at + step :]
    return tool.unused_data if tool.eof else b""


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a compressed stream, member after member, as far as it can be read."""
    tool, held = None, b""
    for piece in pieces:
        held += piece
        while held:
            tool = tool or _tool(held)
            if tool is None:
                if len(held) < LONGEST_MAGIC:
                    break  # the number may go on in the next piece
                return  # what follows the last member
            try:
                held = yield from _fed(tool, held)
            except BROKEN:
                return
            if tool.eof:
                tool = None


def begins_stream(probe: bytes) -> bool:
    """Whether the first bytes can be read as a compressed stream."""
    tool = _tool(probe)
    try:
        for _ in _fed(tool, probe) if tool else ():
            pass
    except BROKEN:
        return False
    return tool is not None


def unpacked(pieces: Iterator[bytes], depth: int = 0) -> Iterator[bytes]:
    """The content of a stream, opened again while it is a stream itself."""
    inside = (piece for piece in members(pieces) if piece)
    head = b""
    for piece in inside:
        head += piece
        if len(head) >= 8:
            break
    again = chain_([head] if head else [], inside)
    if not head.startswith(MAGIC):
        yield from again
    elif depth >= NESTED:
        raise TooLarge
    else:
        yield from unpacked(again, depth + 1)


def streamed(layer: Layer, start: int, end: int, raw: Iterator[bytes]) -> Iterator[Layer | None]:
    """Layers of what the run ``start:end`` holds; all of it has the span of the run. None where the bound ends it."""
    held, total, fresh = b"", 0, 0
    try:
        for piece in unpacked(raw):
            held += piece
            total += len(piece)
            fresh += len(piece)
            if len(held) >= PIECE + OVERLAP:
                yield _spanned(layer, start, end, held)
                held, fresh = held[-OVERLAP:], 0
            if total > OPENED_BYTES:
                raise TooLarge
    except TooLarge:
        yield None
    if fresh:
        yield _spanned(layer, start, end, held)


def _spanned(layer: Layer, start: int, end: int, raw: bytes) -> Layer:
    found = characters(raw)
    # bytes that are no text may have text among them
    text = found[0] if found and not CONTROL.search(found[0]) else "\n".join(m.group().decode() for m in STRETCH.finditer(raw))
    whole = np.ones(len(text), np.int32)
    return layer.derived(text, whole * start, whole * end)


def base64_layers(layer: Layer) -> Iterator[Layer | None]:
    """Layers of base64 runs that hold text or compressed text; None for one too large to open.

    A run may follow or precede other characters of the alphabet. So compressed streams are looked for at every place, and all
    four alignments are tried until one is text as a whole; failing that, printable stretches of any of them are layers.
    """
    upto = 0
    for m in BASE64.finditer(layer.text):
        start, end = m.span()
        if start < upto:
            continue
        if end - start in FULL_LINE and (more := WRAPPED.match(layer.text, end)):
            end = more.end()
        upto = end
        run, place = layer.text[start:end].translate(URL_SAFE), None
        if "\n" in run:
            place = np.array([i for i, c in enumerate(run) if c not in "\r\n"])
            run = run.translate(WRAPS)
        packed = False
        for m in MAGIC_BASE64.finditer(run):
            head = run[m.start() : m.start() + PROBE]
            if begins_stream(binascii.a2b_base64(head[: len(head) // 4 * 4])):
                packed = True
                yield from streamed(layer, start, end, _decoded(run, m.start()))
        partial: list[Layer] = []
        for shift in range(4):
            size = len(run) - shift
            size -= size % 4 == 1
            if size < LEAST_BASE64:
                break
            raw = binascii.a2b_base64(run[shift : shift + size] + "=" * (-size % 4))
            found = characters(raw)
            if found and not CONTROL.search(found[0]):
                yield _of_octets(layer, start, shift, place, *found)
                break
            if not packed:
                for part in STRETCH.finditer(raw):
                    at = np.arange(part.start(), part.end())
                    partial.append(_of_octets(layer, start, shift, place, part.group().decode(), at, at + 1))
        else:
            yield from partial


def _decoded(run: str, start: int) -> Iterator[bytes]:
    """The octets of a base64 run from a place on, some at a time."""
    for at in range(start, len(run), CHUNK):
        part = run[at : at + CHUNK]
        part = part[: len(part) - (len(part) % 4 == 1)]
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def _of_octets(layer: Layer, at: int, shift: int, place, text: str, begin: np.ndarray, stop: np.ndarray) -> Layer:
    """A layer of decoded octets ``begin:stop``, mapped to the characters of the run that begins at ``at``."""
    first, last = shift + begin * 8 // 6, shift + (stop * 8 - 1) // 6
    if place is not None:
        first, last = place[first], place[last]
    return layer.derived(text, (at + first).astype(np.int32), (at + last + 1).astype(np.int32))


def scan(text: str) -> tuple[list[tuple], list[tuple], int]:
    """Base spans, all spans (each ``(start, kind, end)``, sorted), and runs too large to open."""
    base, spans, unopened = sorted(matches(text)), set(), 0
    spans.update(base)
    seen, work = {(text, 0, len(text))}, deque([Layer(text)])
    while work:
        layer = work.popleft()
        if layer.starts is not None:
            for start, kind, end in matches(layer.text):
                begin, stop = layer.origin(start, end)
                spans.add((begin, kind, stop))
        found: list[Layer | None] = []
        if "%" in layer.text:
            found.append(percent_decoded(layer) or layer)
            found += percent_streams(layer)
        if "\\" in layer.text or "&#" in layer.text:
            found.append(unescaped(layer) or layer)
        for new in [*found, *base64_layers(layer)]:
            if new is None:
                unopened += 1
            elif new is not layer and new.text:
                key = (new.text, *new.origin(0, len(new.text)))
                if key not in seen:
                    seen.add(key)
                    work.append(new)
    return base, sorted(spans), unopened


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of the base spans, and all spans as text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    names = ["doc_id", *counts, "base_sha256", "spans", "n_spans", "n_unopened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                base, spans, unopened = scan(text or "")
                of_kind = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((*of_kind, digest, written(spans), len(spans), unopened))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 2])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_unopened long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    spans = scan(text)[1] if text else []
    if not spans:
        return text
    out, at, upto = [], 0, -1
    for start, _, end in spans:
        if start >= upto:
            out += [text[at if upto < 0 else upto : start], mark]
            at = start
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with secrets blotted out of the text; ``n_chars`` follows where it exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = part.schema.get_field_index("text")
            clean = pa.array([redacted(t) for t in part.column("text").to_pylist()], part.schema.field("text").type)
            yield part.set_column(at, part.schema.field("text"), clean)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out.select(*docs.columns)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
