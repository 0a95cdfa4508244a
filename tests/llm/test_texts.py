"""Token counts, packing, fingerprints and media columns against libraries and round trips."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lendmill.llm import fingerprints as fp
from lendmill.llm import media
from lendmill.llm.packing import pack
from lendmill.llm.registry import byte_vocabulary
from lendmill.llm.token_counts import PairMerger, count_tokens

from .conftest import prose


def test_token_counts_are_the_library_s(odd, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = count_tokens(odd, path, limit=2048).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(nothing, path).count() == 0


@pytest.mark.parametrize("text", ["it's WE'LL don't", "Σίσυφος ΣΑΣ", "é ﬁ ½ Å", "日本語 テスト", "a b c", "😀😀 x_y__z 12345", "İstanbul ǅ", "aaaaaaaaaaaaa aaa"])
def test_token_counts_of_odd_characters(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert PairMerger(path).count([text])[0] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_token_counts_of_every_code_point_and_of_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), PairMerger(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    draw = random.Random(5)
    pool = points[:0x3000] + list("abcdefghij '<|>.,!?12 \n\t") * 300
    mixed = ["".join(draw.choice(pool) for _ in range(draw.randint(1, 12))) for _ in range(50_000)]
    for texts in (points[::3], ["a" + c + "\u0301b's" for c in points[1::3]], mixed):
        assert own.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_unspaced_runs_merge_in_bounded_time():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, draw = Tokenizer.from_file(path), PairMerger(path), random.Random(9)
    texts = ["".join(draw.choices("abcdeilnorst"[:k], k=draw.randint(60, 900))) for k in range(1, 13) for _ in range(30)]
    texts += ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 1_000_000]
    began = time.process_time()
    found = own.count(texts).tolist()
    assert time.process_time() - began < 10
    assert found == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_id_once(odd, rows, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack(odd, **byte_vocabulary(), with_ids=True).collect()
    ids = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows)
    whole = Counter()
    pieces = sorted(got, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start))
    open_: dict = {}
    for r in pieces:
        own = np.frombuffer(r.ids, "<u4")
        assert len(own) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        open_.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(tuple(own.tolist()))
    for (doc_id, tokens), n in Counter((k[0], len(k[1])) for k in ids.elements()).items():
        for _ in range(n):
            at, joined = 0, []
            while at < tokens:
                part = open_[doc_id, tokens, at].pop()
                joined.extend(part)
                at += len(part)
            whole[doc_id, tuple(joined)] += 1
    assert whole == ids and not any(open_.values())
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert pack(nothing, **byte_vocabulary()).count() == 0


def test_packing_of_long_white_space_and_words(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000, "\n" * 2_000_000 + "end", "ab" * 2_500_000, "x" + "\t " * 60_000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids: dict = {}
    for r in sorted(pack(docs, **byte_vocabulary(), with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
    for i, text in enumerate(texts):
        assert np.frombuffer(ids[i], "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_packing_fills_windows_with_neighbours():
    from lendmill.llm.packing import Shard, fill

    cats, dogs = np.arange(100, 130), np.arange(500, 530)
    tails = [np.r_[cats, 1], np.r_[dogs, 2], np.r_[cats, 3], np.r_[dogs, 4]]
    assert Shard(tails).neighbours(0, np.ones(4, bool) & (np.arange(4) != 0)).tolist()[0] == 2
    full, rest = fill(tails, 62)
    assert [[p[0] for p in w] for w in full] == [[0, 2], [1, 3]] and rest == []


def test_packing_brings_related_texts_of_other_tasks_together(spark):
    """Groups of six texts that share rare words, no two of a group in the same task or near each other."""
    words = [prose(1000 + g, 25) for g in range(60)]
    texts = [(g * 6 + k, " ".join([words[g], prose(7, 60), words[g]])) for k in range(6) for g in range(60)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(texts, 6), "doc_id long, text string")
    met: dict = {}
    for r in pack(docs, **byte_vocabulary()).collect():
        met.setdefault(r.sequence_id, set()).add(r.doc_id)
    together = {(a, b) for ids in met.values() for a in ids for b in ids if a < b and a // 6 == b // 6}
    assert len(together) / (60 * 15) > 0.5


def test_packing_asks_again_when_neighbours_are_used_up():
    from lendmill.llm.packing import fill

    cats, dogs = np.arange(100, 105), np.arange(500, 505)
    tails = [np.roll(cats if i % 2 else dogs, i) for i in range(160)]
    full, _ = fill(tails, 400)
    assert [{p[0] % 2 for p in w} for w in full] == [{0}, {1}]


def test_fingerprints_follow_the_order_of_ids(odd, rows, nothing):
    got = fp.fingerprint_documents(odd).collect()
    assert len(got) == len(rows)
    known = [(i, t or "") for i, t, *_ in rows if i is not None and [r[0] for r in rows].count(i) == 1]
    order = sorted((r[0] for r in rows if r[0] is not None), reverse=True)
    for doc_id, text in known:
        after = order[order.index(doc_id) + 1] if order.index(doc_id) + 1 < len(order) else None
        follows = [t or "" for i, t, *_ in rows if i == after]
        hashes = {hashlib.sha256(fp.edited(text, f).encode()).hexdigest() for f in follows}
        own = next(r for r in got if r.doc_id == doc_id)
        assert own.n_chars == len(text) and own.edited_sha256 in hashes and 0 <= own.near_edited <= 1 and 0 <= own.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[3] != prints[2] and prints[7] == prints[8] and prints[4] == prints[5] == ""
    assert fp.fingerprint_documents(nothing).count() == 0
    assert fp.fingerprint_documents(odd.filter("doc_id = 1")).collect()[0].near_next == 1.0


def test_fingerprints_as_a_plain_one_permutation_minhash(rows):
    """Bin by bin in plain Python: the smallest hash of each bin, empty bins filled by probing, low bits packed."""
    import pyarrow as pa

    from lendmill.llm.ragged import shingles, text_bytes, words

    texts = [r[1] for r in rows]
    for text, found in zip(texts, fp.fingerprints(pa.array(texts, pa.string())), strict=True):
        body, offsets = text_bytes(pa.array([text], pa.string()))
        _, _, docs, hashes, _ = words(body, offsets)
        least: dict = {}
        for v in shingles(docs, hashes, 1)[0].tolist():
            least[v >> 56] = min(least.get(v >> 56, 1 << 56), v & (1 << 56) - 1)
        if not least:
            assert found == b""
            continue
        whole = []
        for b in range(fp.BINS):
            attempt = 0
            source = b
            while source not in least and attempt < 64:
                source, attempt = int(fp._PROBES[attempt][b]), attempt + 1
            whole.append(least[source] & 15 if source in least else min(least.values()) & 15)
        assert found == bytes(whole[i] << 4 | whole[i + 1] for i in range(0, fp.BINS, 2))


@pytest.mark.parametrize("drawn", [60, 1])
def test_next_documents_over_many_ranges(spark, drawn, monkeypatch):
    """Every document's edited text and likeness to the next, whatever the ranges; some ranges are empty."""
    monkeypatch.setattr(fp, "DRAWN", drawn)
    texts = {7 * i % 101: prose(i, 5 + i % 60) for i in range(101)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in fp.fingerprint_documents(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, doc_id in enumerate(order):
        after = texts[order[(i + 1) % len(order)]]
        assert got[doc_id].edited_sha256 == hashlib.sha256(fp.edited(texts[doc_id], after).encode()).hexdigest()
    named = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in fp.fingerprint_documents(named).collect()} == {"a", "b", None}


def test_likeness_is_close_to_jaccard():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = list(rng.permutation(words)[:600])
        cut = int(600 * share)
        b = a[:cut] + list(rng.permutation(words)[: 600 - cut])
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        one, two = fp.fingerprints(pa.array([" ".join(a), " ".join(b)]))
        errors.append(abs(fp.likeness(one, two) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
    assert max(errors) < 0.12


def test_media_reads_back_what_it_stores(odd, rows, nothing):
    got = media.media_digests(odd).collect()
    want = Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = {r.doc_id: (r.media_sha256, r.feature) for r in got}
    assert by[1] == by[3] != by[2]
    assert media.media_digests(nothing).count() == 0


def test_any_bytes_and_several_frames_round_trip():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 192 * (media.ROWS + 3), dtype=np.uint8)
    payload[:2000] = 255
    frames = media.read_frames(media.write_frames(payload, np.array([media.ROWS + 3])))[0]
    assert len(frames) == 2 and b"".join(t.tobytes() for _, t in frames) == payload.tobytes()


def _by_hand(width: int, height: int, sampling: list[tuple[int, int]], interval: int, rng) -> tuple[bytes, np.ndarray]:
    """A baseline file with AC coefficients and subsampled colour, written block by block, and its luminance thumbnail."""
    dc = media._codes(media.DC_LENGTHS, media.DC_SYMBOLS)
    ac_lengths, ac_symbols = (0, 2, 2) + (0,) * 13, (0x00, 0x01, 0x12, 0xF0)
    ac = media._codes(ac_lengths, ac_symbols)
    h, v = sampling[0]
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    thumb = np.zeros((high * v, wide * h), np.uint8)
    bits, out, before, count = "", b"", [0] * len(sampling), 0

    def done(bits):
        bits += "1" * (-len(bits) % 8)
        return b"".join(bytes([x]) + (b"\0" if x == 255 else b"") for x in (int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))

    def put(table, symbol):
        code, length = table[symbol]
        return f"{code:0{length}b}"

    for unit in range(wide * high):
        if interval and unit and unit % interval == 0:
            out, bits, before = out + done(bits) + bytes([0xFF, 0xD0 + count % 8]), "", [0] * len(sampling)
            count += 1
        for c, (a, b) in enumerate(sampling):
            for k in range(a * b):
                value = int(rng.integers(-120, 120))
                if c == 0:
                    thumb[unit // wide * v + k // h, unit % wide * h + k % h] = np.clip((value * 8 + 1028) >> 3, 0, 255)
                step, before[c] = value - before[c], value
                size = abs(step).bit_length()
                bits += put(dc, size) + (f"{step if step > 0 else step + (1 << size) - 1:0{size}b}" if size else "")
                bits += put(ac, 0x01) + "1" + put(ac, 0xF0) + put(ac, 0x12) + "10" + put(ac, 0x00)
    out += done(bits)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(sampling))
    scan = bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + bytes([0, 63, 0])
    head = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, bytes([0, *[8] * 64])) + media._segment(0xC0, frame)
    head += media._segment(0xC4, bytes([0, *media.DC_LENGTHS, *media.DC_SYMBOLS, 0x10, *ac_lengths, *ac_symbols]))
    return head + media._segment(0xDD, interval.to_bytes(2, "big")) + media._segment(0xDA, scan) + out + b"\xff\xd9", thumb[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize(("width", "height", "sampling", "interval"), [(50, 33, [(1, 1)], 0), (50, 33, [(2, 2), (1, 1), (1, 1)], 0), (70, 20, [(2, 1), (1, 1), (1, 1)], 3), (8, 8, [(1, 1)], 1)])
def test_thumbnails_of_files_with_detail_and_colour(width, height, sampling, interval):
    raw, want = _by_hand(width, height, sampling, interval, np.random.default_rng(width + interval))
    frame, thumb = media.read_frames([raw])[0][0]
    assert (frame.width, frame.height) == (width, height) and (thumb == want).all()


def test_thumbnails_of_broken_files_are_null(spark):
    raw, _ = _by_hand(16, 16, [(1, 1)], 0, np.random.default_rng(3))
    got = media.thumbnails(spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"nonsense")), (3, None), (4, bytearray(raw[:40]))], "id int, media binary").coalesce(1)).orderBy("id").collect()
    assert [r.width for r in got] == [16, None, None, None]


def test_files_with_fill_bytes_trailing_bytes_and_separate_scans():
    rng = np.random.default_rng(8)
    raw, want = _by_hand(70, 20, [(1, 1)], 3, rng)
    filled = raw.replace(b"\xff\xd9", b"\xff\xff\xff\xd9").replace(b"\xff\xd0", b"\xff\xff\xd0") + b"\0\0trailing"
    assert (media.read_frames([filled])[0][0][1] == want).all()
    # The luminance in a scan of its own, in blocks of the picture, between scans of the others.
    start = raw.index(b"\xff\xda")
    scan, frame = raw[start:-2], raw.index(b"\xff\xc0")
    head = raw[:frame] + media._segment(0xC0, bytes([8, 0, 20, 0, 70, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + raw[frame + 13 : start]
    other = scan[:5] + bytes([2]) + scan[6:]
    assert raw[frame + 2 : frame + 4] == b"\0\x0b"
    for scans in (scan + other, other + scan + other):
        assert (media.read_frames([head + scans + b"\xff\xd9"])[0][0][1] == want).all()


def test_files_that_lie_cost_what_they_hold(spark):
    raw, _ = _by_hand(16, 16, [(1, 1)], 0, np.random.default_rng(3))
    at = raw.index(b"\xff\xc0") + 5
    large, huge = (raw[:at] + size + raw[at + 4 :] for size in (b"\x40\0\x40\0", b"\xff\xff\xff\xff"))
    flat = raw[: at + 6] + b"\0" + raw[at + 7 :]
    rows = [(i, bytearray(x)) for i, x in enumerate([raw, large, huge, flat, raw[:at], b"\xff\xd8\xff\xd9", raw[:-9]])]
    began = time.process_time()
    thumb = media.read_frames([large])[0][0][1]
    assert thumb.shape == (2048, 2048) and len(np.unique(thumb[1:])) == 1 and time.process_time() - began < 20
    got = media.thumbnails(spark.createDataFrame(rows, "id int, media binary").coalesce(1)).orderBy("id").collect()
    assert [r.width for r in got[:6]] == [16, 16384, None, None, None, None]


def test_long_runs_of_white_space_take_one_pass():
    """Runs just below the length at which the other library takes over: 10 MB within ten seconds, and the library's ids."""
    import time

    import tokenizers

    from lendmill.llm.packing import Encoder
    from lendmill.llm.registry import byte_vocabulary

    own = Encoder(**byte_vocabulary())
    library = tokenizers.Tokenizer.from_file(byte_vocabulary()["file"])
    for part, many in (("a" + " " * 49_999, 200), ("a" + "\n" * 25_000, 400), ("x" + " \n" * 12_500, 400)):
        began = time.perf_counter()
        assert len(own.ids(part * many)) and time.perf_counter() - began < 10
        short = part[:2000] * 2
        assert own.ids(short).tolist() == library.encode(short, add_special_tokens=False).ids
