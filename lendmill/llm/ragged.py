"""Ragged byte and word arrays over Arrow text batches, for the numpy operators.

Everything here works on one bounded batch inside a Spark task: ``blocks`` cuts the batches
Spark delivers by bytes of text, so a few very long documents never add up in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task holds at once (a single longer document forms a block of its own).
BLOCK_BYTES = 2 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
_STEP = np.cumprod(np.full(65536, 0xC2B2AE3D27D4EB4F | 1, dtype=np.uint64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII bytes that are neither letters nor digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), so that every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    array = column.cast(pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, b"")
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def words(
    body: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: np.ndarray = SPACE, prefix: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Runs of bytes between separators: start, length, document and 64-bit hash of each, and of its first bytes.

    With ``lower`` the letters A-Z count as a-z. ``apart`` marks the separating bytes (ASCII white space). With
    ``prefix`` the hash of a word's first so many bytes comes too. A word never crosses documents.
    """
    if lower:
        body = LOWER[body]
    solid = ~apart[body]
    first = np.zeros(len(body) + 1, bool)
    first[offsets[:-1]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64) if prefix else None
    place = np.arange(len(body), dtype=np.int64)
    place -= starts[np.maximum(np.cumsum(begins) - 1, 0)]
    np.maximum(place, 0, out=place)
    value = _BYTE[body]
    value *= _POW[place & 4095]
    if place.max() > 4095:
        value *= _STEP[(place >> 12) & 65535]
    value[~solid] = 0
    hashes = mix64(np.add.reduceat(value, starts))
    lengths = np.add.reduceat(solid, starts, dtype=np.int64)
    docs = np.searchsorted(offsets, starts, "right") - 1
    heads = None
    if prefix:
        value[place >= prefix] = 0
        heads = mix64(np.add.reduceat(value, starts) + _U(1))
    return starts, lengths, docs, hashes, heads


def shingles(docs: np.ndarray, hashes: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in document order and their offsets by document.

    A document with fewer words than ``width`` has its whole word sequence as one shingle, and one
    without words has none. Repeated shingles stay; callers make sets of them.
    """
    counts = np.bincount(docs, minlength=n_docs).astype(np.int64)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(n_docs + 1, np.int64)
    np.cumsum(made, out=out[1:])
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    at = np.arange(out[-1], dtype=np.int64) + np.repeat(first[:-1] - out[:-1], made)
    room = np.repeat(np.minimum(counts, width), made)
    value = np.zeros(len(at), np.uint64)
    for j in range(width):
        inside = j < room
        value += np.where(inside, hashes[np.where(inside, at + j, 0)] * _PLACE[j], _U(0)) if len(hashes) else _U(0)
    value += room.astype(np.uint64) * _PLACE[63]
    return mix64(value), out
