"""Operator 1, token counts: byte-pair merges on ragged arrays, all sequences of a batch in step.

A batch's text is normalized and cut into pre-tokens as the tokenizer file says. Its distinct pre-tokens form one
ragged array of symbol ids. In each round every sequence looks up the ranks of its adjacent pairs, finds its lowest
rank, and merges that pair wherever it occurs in it (left to right, without overlaps); sequences without a mergeable
pair are done. What is counted is the surviving symbols. Counts of pre-tokens are kept from batch to batch in a
table of bounded size, so frequent words are merged once.

A round over short pre-tokens looks at all their pairs again. Long ones (beyond ``LONG`` bytes: unspaced scripts,
encoded data) keep the places of their pairs by rank instead; a round takes the lowest rank of all and its places, and
looks up only the pairs beside what merged. As no pair spans two sequences, each still merges its own lowest rank first.

Texts of code points whose treatment is the same in every version of Unicode (not ``OTHER``) are lowered and cut here; any
other text goes through the normalizer and pre-tokenizer of the file's own library, so their tables decide.

Cases: a null or empty text has 0 tokens; repeated rows are counted each; a text of any length is cut as a whole, in
time by its length and the number of distinct ranks; an empty table gives no rows; extra columns are dropped; a doc_id
of any type is returned as it is. The special strings of the file count as one token each wherever they stand, as is
the library's default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from lendmill.llm.ragged import blocks

#: Pre-tokens whose counts a Python worker keeps, their greatest length, and the bytes from which one counts as long.
KEPT, KEPT_LENGTH, LONG = 600_000, 256, 64
#: Code points that are composed already and whose classes and lower case are stable: ASCII, Latin-1, most of
#: Latin Extended-A, Cyrillic letters, common punctuation. None combines with a neighbour.
OTHER = re.compile("[^\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u012F\u0132-\u0148\u014A-\u017E\u0410-\u044F\u2010-\u2027\u20AC]")
INFINITE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class PairMerger:
    """The vocabulary of a word-level BPE file as sorted arrays of (left, right) -> (rank, merged)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.library = tokenizers.Tokenizer.from_file(path)
        symbols = _byte_symbols()
        self.bytes = {ord(s): b for b, s in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: The token that a merge of each rank makes.
        self.makes = merged
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.merged = keys, first.astype(np.int64), merged[first]
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if OTHER.search(text) is None:
            return self.pattern.findall(text.lower())
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [p.translate(self.bytes).encode("latin-1").decode() for p, _ in parts]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and how many special strings it holds."""
        if self.cut_special is None or "<" not in text:
            return self.cut(text), 0
        parts = self.cut_special.split(text)
        return [x for part in parts for x in self.cut(part)], len(parts) - 1

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``INFINITE`` where they do not merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], INFINITE)

    def symbols(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One ragged array of the sequences' symbols, and each one's sequence."""
        lengths = np.array([len(b) for b in encoded], np.int64)
        ends = np.cumsum(lengths)
        body = np.frombuffer(b"".join(encoded), np.uint8)
        symbol = self.inner[body]
        symbol[ends - 1] = self.last[body[ends - 1]]
        return symbol, np.repeat(np.arange(len(encoded)), lengths)

    def merge_counts(self, encoded: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        long = np.array([len(b) > LONG for b in encoded], bool)
        counts = np.ones(len(encoded), np.int64)
        for chosen, merge in ((~long, self.merge_short), (long, self.merge_long)):
            if chosen.any():
                counts[chosen] = merge([b for b, c in zip(encoded, chosen, strict=True) if c])
        return counts

    def merge_short(self, encoded: list[bytes]) -> np.ndarray:
        """Rank-synchronous merges over one ragged array; every round looks at all pairs left."""
        symbol, owner = self.symbols(encoded)
        counts = np.ones(len(encoded), np.int64)
        while len(symbol) > 1:
            rank = np.where(owner[:-1] == owner[1:], self.rank_of(symbol[:-1], symbol[1:]), INFINITE)
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[begins, len(owner)])
            lowest = np.minimum.reduceat(np.r_[rank, INFINITE], begins)
            lowest_here = np.repeat(lowest, sizes)
            hit = (rank < INFINITE) & (rank == lowest_here[:-1])
            # In a run of overlapping hits (a a a) every second one merges, from the left.
            run = np.r_[False, hit[1:] & hit[:-1]]
            if run.any():
                index = np.arange(len(hit))
                head = np.maximum.accumulate(np.where(hit & ~run, index, -1))
                hit &= (index - head) % 2 == 0
            live = lowest_here < INFINITE
            done = lowest == INFINITE
            counts[owner[begins[done]]] = sizes[done]
            left = np.flatnonzero(hit)
            symbol[left] = self.makes[rank[left]]
            live[left + 1] = False
            symbol, owner = symbol[live], owner[live]
        if len(symbol):
            counts[owner[0]] = 1
        return counts

    def merge_long(self, encoded: list[bytes]) -> np.ndarray:
        """The same with the places of pairs held by rank, so that a round costs what it merges."""
        symbol, owner = self.symbols(encoded)
        n = len(symbol)
        # Neighbours of living places; -1 and n stand outside, and no pair spans two sequences.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = np.flatnonzero(owner[1:] != owner[:-1])
        after[edge], before[edge + 1] = n, -1
        alive = np.ones(n, bool)
        #: Rank of the pair that begins at each place.
        rank = np.full(n, INFINITE)
        inside = np.flatnonzero(after < n)
        rank[inside] = self.rank_of(symbol[inside], symbol[inside + 1])
        held: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def hold(places: np.ndarray) -> None:
            own = rank[places]
            places, own = places[own < INFINITE], own[own < INFINITE]
            if not len(places):
                return
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for r, part in zip(own[starts].tolist(), np.split(places, starts[1:]), strict=True):
                if r not in held:
                    held[r] = []
                    heapq.heappush(waiting, r)
                held[r].append(part)

        hold(inside)
        while waiting:
            r = heapq.heappop(waiting)
            parts = held.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # In a run of overlapping pairs every second one merges, from the left.
            run = np.r_[False, after[at[:-1]] == at[1:]]
            if run.any():
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(run, -1, index))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at], alive[gone] = self.makes[r], False
            after[at] = beyond
            before[beyond[beyond < n]] = at[beyond < n]
            # What merged and what stands before it begin new pairs.
            near = np.concatenate([at, before[at][before[at] >= 0]])
            near = np.unique(near)
            right = after[near]
            rank[near] = INFINITE
            pairs = right < n
            rank[near[pairs]] = self.rank_of(symbol[near[pairs]], symbol[right[pairs]])
            hold(near)
        return np.bincount(owner[alive], minlength=len(encoded))

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known.clear()
        known, cut, total = self.known, [self.pieces(t) for t in texts], np.zeros(len(texts), np.int64)
        fresh = list(dict.fromkeys(p for some, _ in cut for p in some if p not in known))
        if fresh:
            known.update(zip(fresh, self.merge_counts([p.encode() for p in fresh]).tolist(), strict=True))
        for i, (some, special) in enumerate(cut):
            total[i] = sum(map(known.__getitem__, some)) + special
        for p in fresh:
            if len(p) > KEPT_LENGTH:
                del known[p]
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary)
        for batch in blocks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
