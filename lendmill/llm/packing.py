"""Operator 2, lexical retrieval packing: windows filled with a seed's BM25 neighbours.

Every text is turned into token ids with an end id and cut into segments: whole windows, which become sequences of
their own, and what is left of it, its tail. Document frequencies and mean length are those of all segments of the
table. Tails are dealt out by range of their ``ROUTES`` rarest terms that another segment holds too, so tails that
share rare terms meet, wherever they stand in the input; a number from the row's digest parts large groups of equal
terms. A task packs its range in shards of ``SHARD`` tails, each with a BM25 inverted index. A seed's ``TERMS``
heaviest terms retrieve unused neighbours, best first, which fill the seed's window; when they are used up it asks
again, with all its terms at last. The one that does not fit is cut, and its rest is the next seed. So every window is
full; what is left of a shard goes on into the next, and what is left of a task is cut into sequences whose lengths are
powers of two, which need no padding.

The search is within a shard of related tails, not exact over the table; README has its recall against brute force.

Segments are written once to the shared folder, then tails are shuffled once. A sequence's number has the task's
partition in its high bits and below them a bit for whole windows.

The ids are those of the byte-level vocabulary's own library, ``tokenizers``. Its ranks file gives the same ids in a
fifth of the time (118 against 615 CPU seconds a GB) and is used for that; texts with a longer run of white space than
the ranks file's cutter can bear (``WIDE``) go through the library itself. The special string counts as its one id
wherever it stands, as is the library's default.

Cases: a null or empty text is its end id alone; repeated rows are packed each; a text of any length is cut as a whole;
an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmill.llm.ragged import blocks
from lendmill.llm.tasks import shared_folder

SHARD, TERMS, ROUTES = 4096, 24, 3
#: Usual parameters of BM25.
K1, B = 1.2, 0.75
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space whose cutting would overflow the stack of the ranks file's cutter (it fails from about 500,000 on).
WIDE, SPACES = 50_000, re.compile(r"\s+")


class Encoder:
    """Ids of a text by the ranks file, or by the library's own file where that cannot cut the text."""

    def __init__(self, file: str, ranks: str, pattern: str, special: tuple[tuple[str, int], ...]):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.file, self.library = file, None
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(special))
        self.special, self.n_vocab = {s for s, _ in special}, self.fast.n_vocab

    def ids(self, text: str) -> np.ndarray:
        # One pass over the runs of white space: trying for a long one at every place would be quadratic.
        if len(text) < WIDE or all(m.end() - m.start() < WIDE for m in SPACES.finditer(text)):
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        if self.library is None:
            self.library = tokenizers.Tokenizer.from_file(self.file)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(file: str, ranks: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(file, ranks, pattern, special)


class Shard:
    """A BM25 index over some tails and the greedy filling of windows."""

    def __init__(self, tails: list[np.ndarray], corpus: tuple[np.ndarray, int, float] | None = None):
        """``corpus``: segments that hold each term, their number and mean length; without it the tails' own."""
        self.sizes = np.array([len(t) for t in tails], np.int64)
        owner = np.repeat(np.arange(len(tails)), self.sizes)
        joint, count = np.unique(np.concatenate(tails).astype(np.int64) * len(tails) + owner, return_counts=True)
        term, doc = joint // len(tails), (joint % len(tails)).astype(np.int32)
        values, first, holders = np.unique(term, return_index=True, return_counts=True)
        known, many, mean = (holders, len(tails), self.sizes.mean()) if corpus is None else (corpus[0][values], *corpus[1:])
        idf = np.log(1 + (many - known + 0.5) / (known + 0.5))
        row = np.repeat(np.arange(len(values)), holders)
        norm = K1 * (1 - B + B * self.sizes / mean)
        weight = idf[row] * count * (K1 + 1) / (count + norm[doc])
        self.doc, self.weight, self.start, self.end = doc, weight, first, first + holders
        # The terms by which a tail asks: those with the greatest weight that another tail holds too.
        asks = np.flatnonzero(holders[row] > 1)
        asks = asks[np.lexsort((-weight[asks], doc[asks]))]
        edge = np.searchsorted(doc[asks], np.arange(len(tails) + 1))
        self.asked = [row[asks[a:b]] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def neighbours(self, seed: int, unused: np.ndarray, most: int = 24, terms: int | None = TERMS) -> np.ndarray:
        """Unused tails that share one of the seed's first terms (None: any term), best first."""
        terms = self.asked[seed][:terms]
        if not len(terms):
            return terms
        at = np.concatenate([np.arange(self.start[t], self.end[t]) for t in terms.tolist()])
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(unused)) * unused
        best = np.argpartition(-score, min(most, len(score) - 1))[:most]
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]

    def all_neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused tails that share a term with the seed: asked for again when used up, at last with all terms."""
        for terms in (TERMS, None):
            most = 24
            while len(found := self.neighbours(seed, unused, most, terms)):
                yield from (i for i in found.tolist() if unused[i])
                most *= 2


def fill(tails: list[np.ndarray], window: int, corpus: tuple[np.ndarray, int, float] | None = None) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of (tail, from, to) parts, and the parts of the one that stays open."""
    index = Shard(tails, corpus)
    unused = np.ones(len(tails), bool)
    full, order = [], iter(range(len(tails)))
    part: tuple[int, int, int] | None = None
    while True:
        if part is None:
            seed = next((i for i in order if unused[i]), None)
            if seed is None:
                return full, []
            unused[seed], part = False, (seed, 0, int(index.sizes[seed]))
        parts, room, part = [part], window - (part[2] - part[1]), None
        found = index.all_neighbours(parts[0][0], unused)
        while room:
            i = next(found, None)
            if i is None:
                i = next((x for x in order if unused[x]), None)
                if i is None:
                    return full, parts
            unused[i], size = False, int(index.sizes[i])
            parts.append((i, 0, min(size, room)))
            if size > room:
                part = (i, room, size)
            room -= min(size, room)
        full.append(parts)


def segments(docs: DataFrame, file: str, ranks: str, pattern: str, special: tuple[tuple[str, int], ...], window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces for whole windows, tails with their ids (no sequence_id), and for each task the segments that hold a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file, ranks, pattern, special)
        number = TaskContext.get().partitionId() << 40 | 1 << 39
        holders, schema = np.zeros(max(own.n_vocab, end_id + 1), np.int32), None
        for batch in blocks(batches):
            if schema is None:
                ints = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                lists = [(n, pa.list_(pa.int32())) for n in ("terms", "holders")]
                schema = pa.schema([("doc_id", batch.column("doc_id").type), *((n, pa.int64()) for n in ints), ("ids", pa.binary()), *lists])
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(own.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    whole, raw = len(part) == window, part.tobytes()
                    holders[np.unique(part)] += 1
                    rows.append((doc_id, a, len(part), zlib.crc32(raw), len(ids), number if whole else None, 0, raw if with_ids or not whole else None, None, None))
                    number += whole
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if schema is not None:
            terms = np.flatnonzero(holders)
            row = (None,) * 8 + (terms.tolist(), holders[terms].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}, ids binary, terms array<int>, holders array<int>")


def corpus_of(made: DataFrame) -> tuple[np.ndarray, int, float]:
    """Segments that hold each term, their number and mean length, over the table; terms are at most the vocabulary's."""
    many, mean = made.filter("terms is null").agg(F.count("*"), F.avg("length")).first()
    pairs = made.filter("terms is not null").select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy("t.terms").agg(F.sum("t.holders").alias("n")).toPandas()
    holders = np.zeros(int(pairs["terms"].max()) + 1 if len(pairs) else 1, np.int64)
    holders[pairs["terms"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    return holders, many, mean or 1.0


def routed(tails: DataFrame, holders: np.ndarray) -> DataFrame:
    """Tails dealt out and ordered by their rarest terms that another segment holds too."""
    keys = [f"route{k}" for k in range(ROUTES)]
    rank = np.empty(len(holders), np.int32)
    rank[np.argsort(np.where(holders > 1, holders, np.iinfo(np.int64).max), kind="stable")] = np.arange(len(holders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full((batch.num_rows, ROUTES), len(holders), np.int32)
            for i, raw in enumerate(batch.column("ids").to_pylist()):
                terms = np.unique(np.frombuffer(raw, "<u4"))
                best = np.sort(rank[terms[holders[terms] > 1]])[:ROUTES]
                found[i, : len(best)] = best
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in found.T)], [*batch.schema.names, *keys])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tails.schema.fields)
    order = [*keys, "salt", "place"]
    dealt = tails.mapInArrow(run, kinds + "".join(f", {k} int" for k in keys))
    dealt = dealt.withColumns({"salt": F.xxhash64("doc_id", "start", "ids_crc32"), "place": F.monotonically_increasing_id()})
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*tails.columns)


def pack(docs: DataFrame, file: str, ranks: str, pattern: str, special: tuple[tuple[str, int], ...], window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: where each begins in its document's ids, and its place in a sequence.

    ``with_ids`` adds the piece's ids (little-endian unsigned 32-bit).
    """
    kind, spark = docs.schema["doc_id"].dataType, docs.sparkSession
    cut = segments(docs, file, ranks, pattern, special, window, end_id, with_ids)
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    cut.write.parquet(folder)
    made = spark.read.schema(cut.schema).parquet(folder)
    corpus = corpus_of(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        #: doc_id, place in the document, its tokens, ids
        tails: list[tuple] = []

        def put(doc_id, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> None:
            raw = ids.astype("<u4").tobytes()
            rows.append((doc_id, start, len(ids), zlib.crc32(raw), tokens, sequence, offset, raw))

        def put_window(parts: list[tuple[int, int, int]]) -> None:
            nonlocal number
            offset = 0
            for i, a, b in parts:
                doc_id, start, tokens, ids = tails[i]
                put(doc_id, start + a, ids[a:b], tokens, number, offset)
                offset += b - a
            number += 1

        def shard() -> list[tuple]:
            full, rest = fill([t[3] for t in tails], window, corpus)
            for parts in full:
                put_window(parts)
            return [(tails[i][0], tails[i][1] + a, tails[i][2], tails[i][3][a:b]) for i, a, b in rest]

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:7]), *([pa.array(columns[7], pa.binary())] if with_ids else [])]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        schema = None
        for batch in batches:
            if schema is None:
                names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                schema = pa.schema([("doc_id", batch.column("doc_id").type), *((n, pa.int64()) for n in names), *([("ids", pa.binary())] if with_ids else [])])
            for doc_id, start, tokens, raw in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                tails.append((doc_id, start, tokens, np.frombuffer(raw, "<u4")))
                if len(tails) >= SHARD:
                    tails = shard()
            if rows:
                yield made()
        if tails:
            tails = shard()
            left, parts, size = sum(len(t[3]) for t in tails), [], 0
            for i, (_, _, _, ids) in enumerate(tails):
                a = 0
                while a < len(ids):
                    aim = 1 << (left.bit_length() - 1)
                    took = min(len(ids) - a, aim - size)
                    parts.append((i, a, a + took))
                    a, size = a + took, size + took
                    if size == aim:
                        put_window(parts)
                        left, parts, size = left - aim, [], 0
        if rows:
            yield made()

    tails = routed(made.filter("sequence_id is null and terms is null").select("doc_id", "start", "doc_tokens", "ids_crc32", "ids"), corpus[0])
    packed = tails.mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECES}" + (", ids binary" if with_ids else ""))
    return made.filter("sequence_id is not null").select(*packed.columns).unionByName(packed)
