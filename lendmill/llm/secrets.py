"""Operator 11, secret scans: a recursive decoding worklist over every whole text.

A text is the first layer. Each layer is scanned for secrets, and every way to unwrap it gives another layer, in which
the wrapped parts are replaced by what they hold and all around them stays:

- ``url``: runs of percent escapes as UTF-8, else byte by byte as Latin-1;
- ``unicode``: backslash escapes (u with four digits, surrogate pairs, u with braces, U, x), ``%u`` and numeric references;
- ``base64``: runs of ``SHORTEST`` characters and more of either alphabet, also in lines of 64 or 76, with or without
  padding, that hold UTF-8 or little-endian UTF-16 without control characters;
- ``packed``: base64 runs, runs of hexadecimal digits or percent-escaped runs that hold gzip, zlib, bzip2, xz or
  Zstandard data (packed any number of times) with such a text.

Layers wait in a worklist until none gives a new one. A layer whose text was seen before is left out, which ends cycles
(data that unpack to themselves too); every other way but unpacking makes a layer shorter. Each layer knows where its
parts came from, so a span found in it is mapped back layer by layer to code points of the whole text: an escape to its
own characters, a base64 character to the four that hold it, packed data to their whole run.

Cases: null is the empty text, which has no span; secrets of a layer that lie at the same place as one found before
count once; a text of any length is scanned as a whole; repeated rows are scanned each; wrong escapes, broken base64 and
broken or cut compressed data stay as they are; data that unpack to more than ``MOST_OPENED`` bytes stay packed and are
counted in ``refused`` (a bomb must not end the task); an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import binascii
import bz2
import gzip
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lendmill.llm.ragged import blocks

#: Least length of a base64 run: 12 bytes, no secret of a kind below is shorter. Bytes that packed data may hold.
SHORTEST, MOST_OPENED = 16, 1 << 25
# The kinds of secrets in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

Span = tuple[int, int, int]
#: A wrapped part of a layer: from, to, its text, and where each of its characters lies (None: all in the whole part).
Part = tuple[int, int, str, np.ndarray | None, np.ndarray | None]


def scan(text: str) -> list[Span]:
    """(start, kind's number, end) of the secrets of a text, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _has_run(text.encode(), _HEX_MARKS, 24):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _marking(characters: str) -> bytes:
    """A translation of bytes: ``x`` for these characters, a space for all others."""
    return bytes(120 if b < 128 and chr(b) in characters else 32 for b in range(256))


_DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_MARKS, _RUN_MARKS = _marking(_DIGITS + "abcdef"), _marking(_DIGITS + _LETTERS + "+/_-")


def _has_run(raw: bytes, marks: bytes, length: int) -> bool:
    """Whether so many marked characters follow each other: a quick test before a pattern is tried at every place."""
    return b"x" * length in raw.translate(marks)


class Layer:
    """A text and, but for the first, the layer that it came from with the place of every piece in it."""

    def __init__(self, text: str, depth: int = 0, parent: Layer | None = None, pieces: tuple[np.ndarray, ...] = (), via: str = ""):
        self.text, self.depth, self.parent, self.via = text, depth, parent, via
        #: Of each piece: where it begins here, where it begins and ends in the parent, whether it was copied.
        self.at, self.low, self.high, self.copied = pieces or (None,) * 4

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first layer that holds a span of this one."""
        layer = self
        while layer.parent is not None:
            a = bisect_right(layer.at, start) - 1
            b = bisect_right(layer.at, end - 1) - 1
            start = int(layer.low[a] + (start - layer.at[a] if layer.copied[a] else 0))
            end = int(layer.low[b] + (end - layer.at[b]) if layer.copied[b] else layer.high[b])
            layer = layer.parent
        return start, end

    def without(self, parts: list[Part], via: str) -> Layer:
        """The layer in which the parts are replaced by their texts."""
        texts, at, low, high, copied, size, done = [], [], [], [], [], 0, 0

        def put(text: str, starts, ends, places, plain: bool) -> None:
            nonlocal size
            if text:
                texts.append(text)
                at.append(places + size)
                low.append(starts)
                high.append(ends)
                copied.append(np.full(len(places), plain))
                size += len(text)

        one = np.zeros(1, np.int64)
        for a, b, text, starts, ends in parts:
            put(self.text[done:a], one + done, one + a, one, True)
            if starts is None:
                put(text, one + a, one + b, one, False)
            else:
                put(text, starts, ends, np.arange(len(text)), False)
            done = b
        put(self.text[done:], one + done, one + len(self.text), one, True)
        pieces = tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, low, high, copied))
        return Layer("".join(texts), self.depth + 1, self, pieces, via)


ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
CONTINUED = np.arange(256) >> 6 == 2


def bytes_of_characters(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each character of UTF-8 bytes."""
    first = np.flatnonzero(~CONTINUED[np.frombuffer(raw, np.uint8)])
    return first, np.append(first[1:], len(raw))


def unwrap_url(text: str) -> list[Part]:
    parts: list[Part] = []
    for m in ESCAPES.finditer(text) if "%" in text else ():
        raw, a = bytes.fromhex(m[0].replace("%", "")), m.start()
        try:
            shown, (first, last) = raw.decode(), bytes_of_characters(raw)
        except UnicodeDecodeError:
            shown, first, last = raw.decode("latin-1"), np.arange(len(raw)), np.arange(1, len(raw) + 1)
        parts.append((a, m.end(), shown, a + 3 * first, a + 3 * last))
    return parts


_H = "[0-9A-Fa-f]"
CODES = re.compile(
    rf"(?:\\u|%u)([Dd][89ABab]{_H}{{2}})(?:\\u|%u)([Dd][C-Fc-f]{_H}{{2}})|(?:\\u|%u)({_H}{{4}})|\\u\{{({_H}{{1,6}})\}}|\\U({_H}{{8}})|\\x({_H}{{2}})"
    rf"|&#[Xx]({_H}{{1,6}});|&#([0-9]{{1,7}});"
)


def unwrap_unicode(text: str) -> list[Part]:
    parts: list[Part] = []
    for m in CODES.finditer(text) if "\\" in text or "&#" in text or "%u" in text else ():
        if m[1]:
            code = 0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF)
        else:
            code = int(m[8]) if m[8] else int(next(g for g in m.groups()[2:7] if g), 16)
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), chr(code), None, None))
    return parts


_D = "[A-Za-z0-9+/]"
RUNS = {
    "base64": re.compile(rf"(?<!{_D})(?:(?:(?:{_D}{{76}}\r?\n)+|(?:{_D}{{64}}\r?\n)+){_D}*|{_D}{{{SHORTEST - 2},}})={{0,2}}"),
    "base64url": re.compile(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{SHORTEST - 2},}}={{0,2}}"),
}
CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f]")


def base64_bytes(run: str) -> bytes | None:
    """The bytes of a base64 run without line ends; None if it is none."""
    digits = run.rstrip("=")
    if len(run) < SHORTEST - 2 or len(digits) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(digits.replace("-", "+").replace("_", "/") + "=" * (-len(digits) % 4))
    except binascii.Error:
        return None


def readable(raw: bytes) -> tuple[str, np.ndarray, np.ndarray] | None:
    """A text without control characters in UTF-8, or in UTF-16 where every other byte is 0, with each character's bytes."""
    if len(raw) > 1 and len(raw) % 2 == 0 and not any(raw[1::2]):
        text, first = raw.decode("utf-16-le"), np.arange(0, len(raw), 2)
        last = first + 2
    else:
        try:
            text, (first, last) = raw.decode(), bytes_of_characters(raw)
        except UnicodeDecodeError:
            return None
    return None if CONTROL.search(text) else (text, first, last)


Run = tuple[int, int, bytes, np.ndarray | None]


def runs(text: str, kind: str) -> list[Run]:
    """(from, to, bytes, places of its digits if it has line ends) of base64 runs; lines follow as runs of their own."""
    found: list[Run] = []
    for m in RUNS[kind].finditer(text):
        run = m[0]
        if "\n" in run:
            whole = run.replace("\r", "").replace("\n", "")
            found.append((m.start(), m.end(), base64_bytes(whole), np.flatnonzero(~np.isin(np.frombuffer(run.encode(), np.uint8), (10, 13)))))
            found += [(m.start() + n.start(), m.start() + n.end(), base64_bytes(n[0]), None) for n in re.finditer("[^\r\n]+", run)]
        else:
            found.append((m.start(), m.end(), base64_bytes(run), None))
    return [r for r in found if r[2] is not None]


def unwrap_base64(found: list[Run]) -> list[Part]:
    parts: list[Part] = []
    for a, b, raw, places in found:
        shown = readable(raw) if not parts or a >= parts[-1][1] else None
        if shown is not None:
            first, last = shown[1] * 8 // 6, (shown[2] * 8 + 5) // 6
            if places is not None:
                first, last = places[first], places[last - 1] + 1
            parts.append((a, b, shown[0], a + first, a + last))
    return parts


def _inflated(raw: bytes) -> bytes:
    d = zlib.decompressobj()
    made = d.decompress(raw, MOST_OPENED + 1)
    if len(made) <= MOST_OPENED and not d.eof:
        raise EOFError
    return made


def _zstandard(raw: bytes) -> bytes:
    made = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read(MOST_OPENED + 1)
    if len(made) < zstandard.frame_content_size(raw) and len(made) <= MOST_OPENED:
        raise EOFError
    return made


#: First bytes of packed data, and how to read it up to a byte more than it may hold.
OPENERS: list[tuple[tuple[bytes, ...], Callable[[bytes], bytes]]] = [
    ((b"\x1f\x8b",), lambda raw: gzip.GzipFile(fileobj=io.BytesIO(raw)).read(MOST_OPENED + 1)),
    ((b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"), _inflated),
    ((b"BZh",), lambda raw: bz2.BZ2File(io.BytesIO(raw)).read(MOST_OPENED + 1)),
    ((b"\xfd7zXZ\x00",), lambda raw: lzma.LZMAFile(io.BytesIO(raw)).read(MOST_OPENED + 1)),
    ((b"\x28\xb5\x2f\xfd",), _zstandard),
]
_BROKEN = (EOFError, OSError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError)


class TooLarge(Exception):
    """Packed data that hold more than may be opened."""


def opened(raw: bytes) -> str | None:
    """The text that packed bytes hold, however often packed; None where there is none or the data unpack to themselves."""
    seen: set[bytes] = set()
    while raw[:6] and raw not in seen:
        opener = next((o for marks, o in OPENERS if raw.startswith(marks)), None)
        if opener is None:
            break
        seen.add(raw)
        try:
            raw = opener(raw)
        except _BROKEN:
            return None
        if len(raw) > MOST_OPENED:
            raise TooLarge
    shown = readable(raw) if seen and raw not in seen else None
    return None if shown is None else shown[0]


PACKED_RUNS = re.compile(r"(?<![A-Za-z0-9_.~%-])[A-Za-z0-9_.~%-]{18,}")
HEX_RUNS = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){18,}(?![0-9A-Fa-f])")
MAGIC = tuple(m for marks, _ in OPENERS for m in marks)


def unwrap_packed(text: str, found: list[Run], refused: list[int]) -> list[Part]:
    tried = [(a, b, raw) for a, b, raw, _ in found if raw.startswith(MAGIC)]
    if _has_run(text.lower().encode(), _HEX_MARKS, 36):
        tried += [(m.start(), m.end(), bytes.fromhex(m[0])) for m in HEX_RUNS.finditer(text) if bytes.fromhex(m[0][:12]).startswith(MAGIC)]
    if "%" in text:
        tried += [(m.start(), m.end(), raw) for m in PACKED_RUNS.finditer(text) if "%" in m[0] and (raw := unquote_to_bytes(m[0])).startswith(MAGIC)]
    parts: list[Part] = []
    for a, b, raw in sorted(tried, key=lambda t: (t[0], -t[1])):
        if parts and a < parts[-1][1]:
            continue
        try:
            shown = opened(raw)
        except TooLarge:
            refused[0] += 1
            continue
        if shown is not None:
            parts.append((a, b, shown, None, None))
    return parts


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def find_secrets(text: str) -> tuple[list[tuple[int, int, int, bool, int, str]], int, int]:
    """Spans (start, kind's number, end, in the text itself, depth, ways of unwrapping), layers and refused data of a text."""
    refused = [0]
    found = {span: (True, 0, "") for span in scan(text)}
    work, seen = deque([Layer(text)]), set()
    while work:
        layer = work.popleft()
        some = _has_run(layer.text.encode(), _RUN_MARKS, SHORTEST - 2)
        plain, other = (runs(layer.text, kind) if some else [] for kind in RUNS)
        ways = {
            "url": unwrap_url(layer.text),
            "unicode": unwrap_unicode(layer.text),
            "base64": unwrap_base64(plain),
            "base64url": unwrap_base64(other),
            "packed": unwrap_packed(layer.text, plain + other, refused),
        }
        for via, parts in ways.items():
            if not parts:
                continue
            made = layer.without(parts, f"{layer.via}>{via}" if layer.via else via)
            seen = seen or {_digest(text)}
            key = _digest(made.text)
            if key in seen:
                continue
            seen.add(key)
            work.append(made)
            for start, kind, end in scan(made.text):
                low, high = made.place(start, end)
                found.setdefault((low, kind, high), (False, made.depth, made.via))
    return sorted((*span, *how) for span, how in found.items()), max(1, len(seen)), refused[0]


SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, depth: int, via: string>>"


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, layers, refused) of every whole text; spans by start, then kind, then end."""
    kind = docs.schema["doc_id"].dataType
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("depth", pa.int32()), ("via", pa.string())]
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("spans", pa.list_(pa.struct(fields))), ("layers", pa.int32()), ("refused", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in fields]
        for batch in blocks(batches):
            made = [find_secrets(text.as_py() or "") for text in batch.column("text")]
            spans = [[dict(zip(names, (KINDS[k], a, b, *how), strict=True)) for a, k, b, *how in found] for found, _, _ in made]
            columns = [batch.column("doc_id").to_pylist(), spans, [m[1] for m in made], [m[2] for m in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, spans {SPANS}, layers int, refused int")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the spans in the texts themselves, and all spans of the texts and their layers."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return secret_spans(docs).select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"), added, "layers", "refused")
