"""Operator 8, media columns: baseline JPEG, read as DC-only luminance thumbnails in numpy.

``read_frames`` parses the markers of baseline JPEG files (one frame or several after each other), Huffman-decodes their
scans and reconstructs the thumbnail that the luminance blocks' DC coefficients make, one sample for each 8 x 8 block;
AC coefficients are only passed over. All restart intervals of a batch are decoded in step, one lane each.

``write_frames`` stores bytes losslessly in the unit that a thumbnail has: every byte is the DC coefficient of a flat
block (quantized by 8, so a step is one grey level), 192 blocks a row, each row a restart interval. A thumbnail of the
file then is the payload, and any JPEG reader shows it as a picture eight times as wide and high.

A file may have fill bytes before a marker, bytes after its end that begin no further image, and a scan for each component
(the one with luminance is read). A lane of restart intervals takes part only as long as bits of it are left, so a file
that declares a larger picture than it holds costs what it holds; units beyond its end repeat the last level.

Cases: a null or empty text becomes a payload of 192 spaces; a payload beyond ``ROWS`` rows goes on in a further frame,
as a JPEG's height is limited; equal texts have equal files; repeated rows are stored each; an empty table gives no rows;
a doc_id of any type is returned as it is; extra columns are dropped, and kept by ``thumbnails``, which needs names of
its own for what it adds. Bytes that are no baseline JPEG raise ``ValueError`` in ``read_frames`` and give null
thumbnails in ``thumbnails``, as do pictures of more than ``MOST_SAMPLES`` luminance blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lendmill.llm.ragged import blocks, text_bytes

#: Payload bytes (blocks) in a row, and rows in a frame: 65535 lines of pixels at most.
ROW, ROWS = 192, 8191
#: Luminance blocks of a picture at most (the format's limit is four times as many).
MOST_SAMPLES = 1 << 24
#: Text bytes that are written at once; writing and reading run beside each other in an executor.
BLOCK = 1 << 19
# Fixed values of the JPEG format: code lengths of the usual luminance DC table, one symbol for each size in bits.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: An AC table with the end of a block alone, in one bit.
AC_LENGTHS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def _codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    code, at, out = 0, 0, {}
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    quant = bytes([0, 8] + [1] * 63)
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    dc, ac = bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS]), bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


_CODE = np.array([_codes(DC_LENGTHS, DC_SYMBOLS)[s][0] for s in range(9)], np.int64)
_LENGTH = np.array([_codes(DC_LENGTHS, DC_SYMBOLS)[s][1] for s in range(9)], np.int64)
_SIZE = np.array([abs(v).bit_length() for v in range(-255, 256)], np.int64)


def write_frames(payload: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A file for each payload; ``counts`` has the rows of each in the joint array."""
    rows = payload.reshape(-1, ROW).astype(np.int64) - 128
    step = np.diff(rows, axis=1, prepend=0)
    size = _SIZE[step + 255]
    bits = (_CODE[size] << size | np.where(step > 0, step, step + (1 << size) - 1)) << 1  # the last bit ends the block
    length = _LENGTH[size] + size + 1
    ends = np.cumsum(length, axis=1)
    n_bytes = -(-ends[:, -1] // 8)
    start = np.cumsum(n_bytes) - n_bytes
    at = (start * 8)[:, None] + ends - length
    first, word = (at >> 3).ravel(), (bits << (24 - (at & 7) - length)).ravel()
    total = int(n_bytes.sum())
    out = sum(np.bincount(first + j, weights=(word >> 16 - 8 * j) & 255, minlength=total + 2) for j in range(3))
    out[start + n_bytes - 1] += (1 << n_bytes * 8 - ends[:, -1]) - 1  # fill bits are ones
    data = out[:total].astype(np.uint8)
    full = data == 0xFF
    stuffed = np.repeat(data, 1 + full)
    shift = np.cumsum(full)
    stuffed[np.flatnonzero(full) + shift[full]] = 0
    edge = np.r_[0, start[1:] + shift[start[1:] - 1], len(stuffed)] if len(start) > 1 else np.array([0, len(stuffed)])
    raw = stuffed.tobytes()
    files, row = [], 0
    for count in counts.tolist():
        parts = []
        for a in range(0, count, ROWS):
            held = min(ROWS, count - a)
            parts.append(_header(held))
            for k in range(held):
                parts.append(raw[edge[row + a + k] : edge[row + a + k + 1]])
                parts.append(bytes([0xFF, 0xD0 + k % 8]) if k + 1 < held else b"\xff\xd9")
        files.append(b"".join(parts))
        row += count
    return files


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    #: id, horizontal and vertical sampling, quantization table.
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: Of each component of the scan: DC and AC table.
    tables: list[tuple[bytes, bytes]] = field(default_factory=list)
    step: int = 8
    interval: int = 0
    #: Whether the scan has the luminance alone: then its units are blocks of the picture, not padded to whole groups.
    alone: bool = True
    #: Entropy-coded segments between restart markers.
    lanes: list[tuple[int, int]] = field(default_factory=list)

    def mcu(self) -> tuple[int, int, int, int]:
        """Units of the scan across and down, and luminance blocks in each across and down."""
        top_h, top_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        h, v = self.components[0][1:3]
        if self.alone or len(self.components) == 1:
            wide, high = -(-self.width * h // top_h), -(-self.height * v // top_v)
            return -(-wide // 8), -(-high // 8), 1, 1
        return -(-self.width // (8 * top_h)), -(-self.height // (8 * top_v)), h, v


def _scan_end(raw: bytes, at: int, lanes: list[tuple[int, int]]) -> int:
    """Note the entropy-coded segments from ``at`` on; the place of the marker that ends the scan."""
    start = at
    while True:
        here = at = raw.find(b"\xff", at)
        while at >= 0 and raw[at + 1 : at + 2] == b"\xff":  # fill bytes
            at += 1
        if at < 0 or at + 1 >= len(raw):
            raise ValueError("no end of the scan")
        if raw[at + 1]:
            lanes.append((start, here))
            if not 0xD0 <= raw[at + 1] <= 0xD7:
                return at
            start = at + 2
        at += 2


def _frame(raw: bytes, at: int) -> tuple[Frame, int]:
    """The frame that starts at a place, and the place after it."""
    frame, at, quant, huffman = Frame(), at + 2, {}, {}
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise ValueError("no marker")
        marker = raw[at + 1]
        if marker == 0xD9:
            if not frame.lanes:
                raise ValueError("no scan of the luminance")
            return frame, at + 2
        if marker == 1 or 0xD0 <= marker <= 0xD7:  # markers without a segment
            at += 2
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(raw):
            raise ValueError("no whole segment")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if body[0] != 8 or not frame.width or not frame.height or not frame.components or any(not (1 <= c[1] <= 4 and 1 <= c[2] <= 4) for c in frame.components):
                raise ValueError("not a frame that can be read")
            if frame.mcu()[0] * frame.mcu()[1] * frame.mcu()[2] * frame.mcu()[3] > MOST_SAMPLES:
                raise ValueError("a larger picture than is read")
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            frame.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            first = bool(frame.components) and chosen[:1] and chosen[0][0] == frame.components[0][0]
            lanes: list[tuple[int, int]] = []
            at = _scan_end(raw, at, lanes)
            if not first or frame.lanes:  # a scan of other components
                continue
            if len(chosen) not in (1, len(frame.components)):
                raise ValueError("a scan of some components")
            frame.alone = len(chosen) == 1
            frame.tables = [(huffman[t >> 4], huffman[0x10 | t & 15]) for _, t in chosen]
            if any(max(dc[16:], default=0) > 11 for dc, _ in frame.tables):
                raise ValueError("not a baseline image")
            frame.step, frame.lanes = quant[frame.components[0][3]], lanes


def parse(raw: bytes) -> list[Frame]:
    """Frames of a file by its markers."""
    frames, at = [], 0
    while not frames or raw[at : at + 2] == b"\xff\xd8":
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of an image")
        frame, at = _frame(raw, at)
        frames.append(frame)
    return frames


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits that may come next."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(table[:16], table[16:]).items():
        out[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbol
    return out


def _decode(frames: list[Frame], files: list[bytes], owners: list[int]) -> list[np.ndarray]:
    """Luminance DC values of frames with the same layout and tables, in the order of their scans' units."""
    model = frames[0]
    parts = [files[o][a:b] for f, o in zip(frames, owners, strict=True) for a, b in f.lanes]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts], np.int64)
    kept = np.ones(len(raw), bool)
    kept[1:] = ~((raw[1:] == 0) & (raw[:-1] == 0xFF))
    edges = np.r_[0, np.cumsum(length)]
    kept[edges[:-1][length > 0]] = True
    where = np.r_[0, np.cumsum(kept)]
    data = np.r_[raw[kept], np.full(8, 0xFF, np.uint8)].astype(np.uint32)
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    place = where[edges[:-1]] * 8
    units = np.concatenate([[max(0, min(f.interval or n, n - k * (f.interval or n))) for k in range(len(f.lanes))] for f in frames for n in [f.mcu()[0] * f.mcu()[1]]]).astype(np.int64)
    across, down = model.mcu()[2:]
    layout = [(c, model.tables[c]) for c in range(len(model.tables)) for _ in range(across * down if not c else (model.components[c][1] * model.components[c][2]))]
    tables = {t: _lookup(t) for pair in model.tables for t in pair}
    last = len(ahead) - 1
    first = np.r_[0, np.cumsum(units)]
    found = np.zeros((int(first[-1]), across * down), np.int32)
    before = np.zeros((len(model.tables), len(parts)), np.int64)
    end = where[edges[1:]] * 8

    def peek(at: np.ndarray) -> np.ndarray:
        return (ahead[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    every, read = np.arange(len(parts)), np.zeros(len(parts), np.int64)
    for unit in range(int(units.max(initial=0))):
        here = (units > unit) & (place < end)
        live = every if here.all() else np.flatnonzero(here)
        if not len(live):
            break
        for k, (c, (dc, ac)) in enumerate(layout):
            at = place[live]
            entry = tables[dc][peek(at)]
            if not entry.all():  # fill bits: these lanes end here
                place[live[entry == 0]] = end[live[entry == 0]]
                at, live, entry = at[entry > 0], live[entry > 0], entry[entry > 0]
            at += entry >> 8
            size = entry & 255
            value = (peek(at) >> (16 - size).astype(np.uint32)).astype(np.int64)
            at += size
            value -= np.where((value >> np.maximum(size - 1, 0) == 0) & (size > 0), (1 << size) - 1, 0)
            before[c, live] += value
            if c == 0:
                found[first[live] + unit, k] = before[0, live]
            open_, done = np.arange(len(live)), np.zeros(len(live), np.int64)
            while len(open_):
                entry = tables[ac][peek(at[open_])]
                symbol = entry & 255
                at[open_] += (entry >> 8) + (symbol & 15)
                done[open_] += (symbol >> 4) + 1
                open_ = open_[(symbol != 0) & (done[open_] < 63) & (entry > 0)]
            place[live] = at
        read[live] = unit + 1
    for i in every[read < units]:  # what a lane lacks has its last level
        found[first[i] + read[i] : first[i + 1]] = before[0, i]
    out, lane = [], 0
    for f in frames:
        out.append(found[first[lane] : first[lane + len(f.lanes)]])
        lane += len(f.lanes)
    return out


def read_frames(files: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each file its frames with their thumbnails (8-bit samples), all decoded together."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, frames in enumerate(parsed):
        for j, f in enumerate(frames):
            groups.setdefault((f.alone, tuple(c[1:3] for c in f.components), tuple(f.tables)), []).append((i, j))
    thumbs: dict[tuple[int, int], np.ndarray] = {}
    for members in groups.values():
        own = [parsed[i][j] for i, j in members]
        for (i, j), f, values in zip(members, own, _decode(own, files, [i for i, _ in members]), strict=True):
            wide, high, h, v = f.mcu()
            blocks_ = values.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
            samples = np.clip((blocks_ * f.step + 1028) >> 3, 0, 255).astype(np.uint8)
            top_h, top_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
            rows, columns = -(-f.height * f.components[0][2] // (8 * top_v)), -(-f.width * f.components[0][1] // (8 * top_h))
            thumbs[i, j] = samples[:rows, :columns]
    return [[(f, thumbs[i, j]) for j, f in enumerate(frames)] for i, frames in enumerate(parsed)]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than the mean of all cells."""
    y, x = (np.arange(9) * n // 8 for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    low, high = y[:-1], np.maximum(y[1:], y[:-1] + 1)
    left, right = x[:-1], np.maximum(x[1:], x[:-1] + 1)
    cells = sums[np.ix_(high, right)] - sums[np.ix_(low, right)] - sums[np.ix_(high, left)] + sums[np.ix_(low, left)]
    means = cells / ((high - low)[:, None] * (right - left)[None])
    return f"{int.from_bytes(np.packbits(means.ravel() > means.mean()).tobytes(), 'big'):016x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, filled up with spaces to full rows, as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            body, offsets = text_bytes(batch.column("text"))
            sizes = np.diff(offsets)
            counts = np.maximum(1, -(-sizes // ROW))
            payload = np.full(int(counts.sum()) * ROW, 32, np.uint8)
            start = (np.cumsum(counts) - counts) * ROW
            payload[np.arange(len(body)) + np.repeat(start - offsets[:-1], sizes)] = body
            files = write_frames(payload, counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(files, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def thumbnails(media: DataFrame) -> DataFrame:
    """The rows of ``media`` (a binary column ``media``) with width, height and frames of each file, the thumbnail's samples and hash.

    Null where the bytes are no baseline JPEG; several frames have their samples after each other and the first's size.
    """

    def read(files: list[bytes | None]) -> list[list | None]:
        try:
            found = iter(read_frames([f for f in files if f is not None]))
            return [None if f is None else next(found) for f in files]
        except (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError):
            return [None] if len(files) == 1 else [x for f in files for x in read([f])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media", 2 * BLOCK):
            got = read(batch.column("media").to_pylist())
            samples = [None if g is None else b"".join(t.tobytes() for _, t in g) for g in got]
            names = ["width", "height", "frames", "samples", "thumbnail_hash"]
            columns = [pa.array([None if not g else f(g) for g in got], kind) for f, kind in ((lambda g: g[0][0].width, pa.int32()), (lambda g: g[0][0].height, pa.int32()), (len, pa.int32()))]
            hashes = pa.array([None if not g else "".join(thumbnail_hash(t) for _, t in g) for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(samples, pa.binary()), hashes], [*batch.schema.names, *names])

    added = T.StructType.fromDDL("width int, height int, frames int, samples binary, thumbnail_hash string")
    return media.mapInArrow(run, T.StructType([*media.schema.fields, *added.fields]))


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of what ``thumbnails`` reads back from the files that ``store_texts`` makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            samples, media = rows["samples"], rows["media"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([len(s) for s in samples], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                    pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([f"{w}x{h}x{f}:{x}" for w, h, f, x in zip(rows["width"], rows["height"], rows["frames"], rows["thumbnail_hash"], strict=True)]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return thumbnails(store_texts(docs)).mapInArrow(run, schema)
