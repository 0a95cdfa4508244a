"""Operator 10, n-gram Jaccard join: exact links between word-shingle sets, region by region of a metric space.

Jaccard distance is a metric, and two documents link at a distance of at most a quarter. Documents that share no
shingle lie at distance 1 from each other, so whole documents alone make poor pivots for a corpus. The join therefore
has two layers of pivots:

1. Single shingles are the first pivots. A document is near the pivots it holds and at distance 1 from all others; of
   those it holds it belongs to the first in a global order (rare ones first), which makes the Voronoi regions. By the
   triangle inequality a partner within a quarter lacks at most a quarter of a document's shingles, so a document is
   replicated to as many regions as that window reaches (its first n/4 + 1 pivots): some region then has both
   documents of every link. The order is by document counts inside a fixed part of the hash space (longer documents)
   or over all shingles (short ones), and a document whose window holds only shingles of its own is settled there.
2. Regions that hold the same documents get one label and are joined once. Inside such a region documents are pivots:
   distances to a few of them give links and Voronoi cells, windows of twice the threshold replicate boundary
   documents, and cells join recursively; a cell that no longer shrinks compares its pivots one by one through an
   inverted index. Documents that are already connected are not compared again.
3. A region that is too large for a task is cut by the same rule across tasks: every block of it meets about ``PIVOTS``
   documents of the region, which gives their links, the Voronoi cells and the windows. The members of a cell that its
   pivot is linked with are connected already, so they go on only where a member that is not linked lies within the
   threshold of their distance to the pivot; a region of near copies so ends after one pass over it. Cells that are
   still too large are cut again. A region that its pivots do not part is split into blocks instead, and pairs of blocks
   are tasks of bounded size, without pairs among the members that are connected by the pivot with the most links.

Long documents meet over a fixed part of the hash space. One whose part is too small to hold a common shingle of each
link for certain (at most a quarter of its shingles) meets over all its shingles as well. Of two linked documents without
a common shingle in that part both are of this kind, so no link is lost.

Equal sets are one point of the space (a 63-bit digest), so exact copies are never compared. Shingles travel as packed
arrays dealt by hash; a shingle that very many documents hold streams through its task in bounded memory.

Cases: null and empty texts and texts without words have no shingles and link with nothing; repeated rows fall
together; ties of ids keep the smallest; a null doc_id counts only when its whole group has none; a text of any length is
one set, and holds its task's memory by its length; an empty table gives none; extra columns of any name are ignored by
``jaccard_components`` and kept by ``one_of_each``; a doc_id of any ordered type is returned as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendmill.llm.ragged import blocks, mix64, shingles, text_bytes, words
from lendmill.llm.tasks import Bitmap, bitmap_of, checkpointed, components, dealing_keys, shuffle_partitions

#: A link is 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents of at most SHORT[1] shingles are compared over all of them where one has at most SHORT[0]; the others over
#: the shingles whose hash lies below PART of the hash space.
SHORT, PART = (48, 64), 0.4
#: Entries that a task gathers before it sends them on, and entries of one shingle that make it stream.
FLUSH, HOT = 1 << 21, 4096
#: Documents and shingles of half a region task.
HALF_DOCS, HALF_SHINGLES = 1024, 2 << 20
#: Pivots of a region that is cut across tasks (on average), rounds of cutting, and members that its open cells may have
#: together for each of its own before it is split into blocks instead.
PIVOTS, ROUNDS, GROWN = 8, 5, 1.5
#: Rows of a table of large regions or of their pivots that is broadcast, and parts of each key where it is longer.
FEW, SALTS = 1 << 16, 64
#: Two documents within it are linked, and the window of the triangle inequality.
THRESHOLD = (100 - PERCENT) / 100 + 1e-9

_U = np.uint64
PACKED = "bucket int, kind int, a binary, b binary, c binary"
ENTRIES, TABLE = 0, 1


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, their offsets, and an even 64-bit digest of each set."""
    body, offsets = text_bytes(texts)
    _, _, docs, hashes, _ = words(body, offsets)
    values, ends = shingles(docs, hashes, len(texts))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[ends[:-1][np.diff(ends) > 0]] = True
    counts = np.add.reduceat(np.r_[fresh, False], np.minimum(ends[:-1], len(fresh)), dtype=np.int64) * (np.diff(ends) > 0)
    values = values[fresh]
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    sums = np.zeros(len(texts), np.uint64)
    full = counts > 0
    if full.any():
        sums[full] = np.add.reduceat(mix64(values + _U(1)), out[:-1][full])
    return values, out, mix64(sums + counts.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) & ~_U(1)


def _bucket(values: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return buckets[((mix64(values ^ _U(0x5851F42D4C957F2D)) >> _U(33)) % _U(len(buckets))).astype(np.int64)]


def _packed(bucket: np.ndarray, kind: int, columns: list[np.ndarray], table: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket with its part of the columns as bytes; a table holds values that the last column indexes."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    parts: list[list[bytes]] = [[], [], []]
    for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
        own = [c[a:b] for c in columns]
        if table is not None:
            used, own[-1] = np.unique(own[-1], return_inverse=True)
            own = [own[0], own[1].astype(np.uint16 if len(used) <= 65536 else np.uint32), table[used]]
        for at in range(3):
            parts[at].append(own[at].tobytes() if at < len(own) else b"")
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts]), pa.array(np.full(len(starts), kind, np.int32)), *(pa.array(p, pa.binary()) for p in parts)], ["bucket", "kind", "a", "b", "c"]
    )


def send_windows(docs: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Entries (shingle, document) of every window, dealt by shingle, and sizes of documents, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        refs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        rows = entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ref = np.concatenate(refs)
            yield _packed(_bucket(np.concatenate([s for s, _ in held]), buckets), ENTRIES, [np.concatenate([s for s, _ in held]), np.concatenate([i for _, i in held])], ref)
            size = np.concatenate(sizes)
            yield _packed(_bucket(ref, buckets), TABLE, [ref, size[:, 0].copy(), size[:, 1].copy()])

        for batch in blocks(batches):
            values, ends, keys = shingle_sets(batch.column("text"))
            n = np.diff(ends)
            new = n > 0
            for i, key in enumerate(keys.tolist()):
                if new[i]:
                    new[i] = key not in seen
                    seen.add(key)
            owner = np.repeat(np.arange(len(n)), n)
            # A document whose part may miss all that it shares with a partner meets over all its shingles too.
            part = np.bincount(owner[values < _U(int(PART * 2**64))], minlength=len(n))
            for level, chosen in ((0, new & ((n <= SHORT[1]) | (part <= n // 4))), (1, new & (n > SHORT[0]))):
                if not chosen.any():
                    continue
                place = np.cumsum(chosen) - 1 + rows
                inside = chosen[owner]
                if level:
                    inside &= values < _U(int(PART * 2**64))
                held.append((mix64(values[inside] + _U(2 + level)), place[owner[inside]].astype(np.uint32)))
                kept = np.bincount(owner[inside], minlength=len(n))
                refs.append(keys[chosen] | _U(level))
                sizes.append(np.stack([n[chosen], kept[chosen]], 1).astype(np.int32))
                rows += int(chosen.sum())
                entries += int(inside.sum())
            if entries > FLUSH:
                yield from flush()
                held, refs, sizes, rows, entries = [], [], [], 0, 0
        if rows:
            yield from flush()

    return docs.select("text").mapInArrow(run, PACKED)


class _Entries:
    """(value, reference) entries gathered in a task; values with very many references leave early."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit, self.hot = 0, 2 * FLUSH, np.zeros(0, np.uint64)

    def add(self, *columns: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Keep entries; those of values that are known to be hot come back at once."""
        gone = None
        if len(self.hot):
            hot = np.isin(columns[0], self.hot)
            if hot.any():
                gone, columns = tuple(c[hot] for c in columns), tuple(c[~hot] for c in columns)
        self.parts.append(columns)
        self.size += len(columns[0])
        return gone

    def overflow(self) -> tuple[np.ndarray, ...] | None:
        """Beyond the limit: the entries of all values with at least HOT references so far."""
        if self.size <= self.limit:
            return None
        columns = self.all()
        values, counts = np.unique(columns[0], return_counts=True)
        self.hot = np.union1d(self.hot, values[counts >= HOT])
        hot = np.isin(columns[0], self.hot)
        self.parts, self.size = [tuple(c[~hot] for c in columns)], int((~hot).sum())
        self.limit = max(self.limit, 2 * self.size)
        return tuple(c[hot] for c in columns) if hot.any() else None

    def all(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else ()


def _unique_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (first, second) and which places of it differ from the one before."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(order) else np.zeros(0, bool)


def count_holders(windows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Entries whose shingle more than one document holds, with its count (HOT where it is that or more), dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Entries()

        def hot(found):
            if found is not None:
                yield _packed(_bucket(found[1], buckets), ENTRIES, [found[1], found[0], np.full(len(found[0]), HOT, np.uint32)])

        for batch in batches:
            table = batch.filter(pc.equal(batch.column("kind"), TABLE))
            if table.num_rows:
                yield table
            for row in batch.filter(pc.equal(batch.column("kind"), ENTRIES)).to_pylist():
                shingle, refs = np.frombuffer(row["a"], np.uint64), np.frombuffer(row["c"], np.uint64)
                index = np.frombuffer(row["b"], np.uint16 if len(refs) <= 65536 else np.uint32)
                yield from hot(held.add(shingle, refs[index]))
            yield from hot(held.overflow())
        if held.size:
            shingle, ref = held.all()
            order, fresh = _unique_pairs(shingle, ref)
            shingle, ref = shingle[order][fresh], ref[order][fresh]
            starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
            sizes = np.diff(np.r_[starts, len(shingle)])
            count = np.repeat(sizes, sizes)
            shared = count > 1
            if shared.any():
                yield _packed(_bucket(ref[shared], buckets), ENTRIES, [ref[shared], shingle[shared], np.minimum(count[shared], HOT).astype(np.uint32)])

    return windows.repartition(len(buckets), "bucket").mapInArrow(run, PACKED)


def choose_pivots(counted: DataFrame, buckets: np.ndarray) -> DataFrame:
    """(shingle, document, n) for the regions of each document's window, dealt by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, found = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == TABLE:
                    tables.append((np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.int32), np.frombuffer(row["c"], np.int32)))
                else:
                    found.append((np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint64), np.frombuffer(row["c"], np.uint32)))
        if not found or not tables:
            return
        refs, first = np.unique(np.concatenate([t[0] for t in tables]), return_index=True)
        n, kept = (np.concatenate([t[k] for t in tables])[first].astype(np.int64) for k in (1, 2))
        ref, shingle, count = (np.concatenate([f[k] for f in found]) for k in range(3))
        order, fresh = _unique_pairs(ref, shingle)
        ref, shingle, count = ref[order][fresh], shingle[order][fresh], count[order][fresh]
        own = np.searchsorted(refs, ref)
        # Shingles that no other document holds come first in the order and take up a part of the window.
        room = n // 4 + 1 - (kept - np.bincount(own, minlength=len(refs)))
        order = np.lexsort((shingle, count, own))
        own, shingle = own[order], shingle[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
        inside = rank < room[own]
        if inside.any():
            own, shingle = own[inside], shingle[inside]
            yield _packed(_bucket(shingle, buckets), ENTRIES, [shingle, refs[own] & ~_U(1), n[own].astype(np.int32)])

    return counted.repartition(len(buckets), "bucket").mapInArrow(run, PACKED)


def label_regions(chosen: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Distinct (x, p, n): document x of n shingles is in the region with label p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = _Entries(), {}

        def pairs(key, label, n):
            order, fresh = _unique_pairs(label, key)
            at = order[fresh]
            return _packed(_bucket(key[at], buckets), ENTRIES, [key[at], label[at], n[at]])

        def hot(found):
            if found is not None:
                shingle, key, n = found
                values, inverse = np.unique(shingle, return_inverse=True)
                least = np.full(len(values), ~_U(0))
                np.minimum.at(least, inverse, mix64(key))
                label = np.array([labels.setdefault(int(v), int(x)) for v, x in zip(values, least, strict=True)], np.uint64)
                yield pairs(key, label[inverse], n)

        for batch in batches:
            for row in batch.to_pylist():
                yield from hot(held.add(np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint64), np.frombuffer(row["c"], np.int32)))
            yield from hot(held.overflow())
        if held.size:
            shingle, key, n = held.all()
            order, fresh = _unique_pairs(shingle, key)
            shingle, key, n = (c[order][fresh] for c in (shingle, key, n))
            starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
            sizes = np.diff(np.r_[starts, len(shingle)])
            label = np.repeat(np.minimum.reduceat(mix64(key), starts), sizes)
            several = np.repeat(sizes, sizes) > 1
            if several.any():
                yield pairs(key[several], label[several], n[several])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            key, label, n = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("a", np.uint64), ("b", np.uint64), ("c", np.int32)))
            order, fresh = _unique_pairs(label, key)
            at = order[fresh]
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(label[at].view(np.int64)), pa.array(n[at])], ["x", "p", "n"])

    labelled = chosen.repartition(len(buckets), "bucket").mapInArrow(run, PACKED)
    return labelled.repartition(len(buckets), "bucket").mapInArrow(unique, "x long, p long, n int")


def region_join(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest index that each set is connected with by links, joined by pivots, Voronoi cells and windows."""
    m = len(sets)
    parent = np.arange(m)
    if m < 2:
        return parent
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    value, first = np.unique(np.concatenate(sets), return_inverse=True)
    # Shingles of one set alone count towards its size only.
    holders = np.bincount(first, minlength=len(value))
    shared = holders[first] > 1
    local = np.cumsum(holders > 1) - 1
    ids, owner = local[first[shared]], owner[shared]
    starts = np.zeros(int((holders > 1).sum()) + 1, np.int64)
    np.cumsum(holders[holders > 1], out=starts[1:])
    posting = owner[np.argsort(ids, kind="stable")]
    span = np.searchsorted(owner, np.arange(m + 1))
    weight = np.add.reduceat(np.r_[holders[holders > 1][ids], 0], np.minimum(span[:-1], len(ids))) * (np.diff(span) > 0) / size

    def overlaps(q: int) -> np.ndarray:
        own = ids[span[q] : span[q + 1]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(own) else np.zeros(0, np.int64)
        return np.bincount(posting[at], minlength=m)

    def link(q: int, rows: np.ndarray) -> np.ndarray:
        """Join q with all of the rows within the threshold; their distances to it."""
        common = overlaps(q)[rows]
        union = size[q] + size[rows] - common
        joined = np.unique(np.r_[parent[rows[100 * common >= PERCENT * union]], parent[q]])
        if len(joined) > 1:
            parent[np.isin(parent, joined)] = joined[0]
        return 1 - common / union

    def sweep(rows: np.ndarray) -> None:
        rows = rows[np.argsort(-weight[rows], kind="stable")]
        for i, q in enumerate(rows[:-1]):
            rest = rows[i + 1 :]
            rest = rest[(parent[rest] != parent[q]) & (100 * np.minimum(size[rest], size[q]) >= PERCENT * np.maximum(size[rest], size[q]))]
            if len(rest):
                link(int(q), rest)
            elif (parent[rows] == parent[q]).all():
                return

    def solve(rows: np.ndarray, depth: int) -> None:
        if len(rows) < 2 or (parent[rows] == parent[rows[0]]).all():
            return
        if len(rows) <= 32 or depth == 8:
            return sweep(rows)
        order = rows[np.argsort(-weight[rows], kind="stable")]
        pivots = order[np.unique(np.linspace(0, len(order) - 1, 4).astype(int))]
        far = np.stack([link(int(q), rows) for q in pivots], 1)
        reach = far <= far.min(axis=1, keepdims=True) + 2 * (100 - PERCENT) / 100 + 1e-9
        if reach.sum(axis=0).max() > 0.8 * len(rows):
            return sweep(rows)
        for j in range(len(pivots)):
            solve(rows[reach[:, j]], depth + 1)

    solve(np.arange(m), 0)
    return parent


def _region_links(table: pa.Table) -> pa.Table:
    table = table.sort_by("x")
    keys = table.column("x").to_numpy()
    roots = region_join([np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()])
    joined = roots != np.arange(len(roots))
    return pa.table({"u": keys[joined], "v": keys[roots[joined]]})


def _spread(rows: DataFrame, small: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Join with a row for each key in ``small``; the rows of a key stay spread over many tasks.

    ``small`` has rows for large regions or their pivots only, a few for each thousand documents, and is broadcast where
    they are at most FEW. Otherwise its rows are repeated for each salt; those never are broadcast, as Spark's estimate of
    exploded rows leaves the salts out.
    """
    if few:
        return rows.join(F.broadcast(small), keys, how)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", F.expr(f"pmod(xxhash64(x), {SALTS})").cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")


def _measured(docs: pa.Table, pivots: pa.Table) -> pa.Table:
    """(x, p, n, pivot, d, linked, home, settled) for the cells that a block's documents reach."""
    key, label = docs.column("x").to_numpy(), docs.column("p").to_numpy()
    out: dict[str, list] = {name: [] for name in ("x", "p", "n", "pivot", "d", "linked", "home", "settled")}
    if len(key) and pivots.num_rows:
        sets = [np.frombuffer(s, np.uint64) for s in docs.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        pivots = pivots.sort_by("x")
        names = pivots.column("x").to_numpy()
        common = np.empty((len(sets), len(names)), np.int64)
        other = np.empty(len(names), np.int64)
        for j, raw in enumerate(pivots.column("shingles").to_pylist()):
            own = np.frombuffer(raw, np.uint64)  # sorted
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            common[:, j], other[j] = np.bincount(owner[own[at] == values], minlength=len(sets)), len(own)
        union = size[:, None] + other - common
        far, linked = 1 - common / union, 100 * common >= PERCENT * union
        row, cell = np.nonzero(far <= far.min(axis=1, keepdims=True) + 2 * THRESHOLD)
        home = far.argmin(axis=1)
        out = {
            "x": key[row], "p": label[row], "n": size[row].astype(np.int32), "pivot": names[cell], "d": far[row, cell], "linked": linked[row, cell],
            "home": home[row] == cell, "settled": np.isin(key, names)[row],
        }
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_())
    return pa.table({name: pa.array(c, kind) for (name, c), kind in zip(out.items(), kinds, strict=True)})


def _still_open(cells: DataFrame, few: bool) -> DataFrame:
    """Members of cells that may have a link which the pivots have not shown.

    A cell owes the links of its home documents with all its members, but for pairs that are both linked with the pivot.
    A member stays if the distances of such partners to the pivot, taken as a range, come within the threshold of its own.
    """
    groups = {"hu": "home and not linked", "hs": "home and linked", "vu": "not home and not linked", "vs": "not home and linked"}
    bounds = [f(F.when(F.expr(e), F.col("d"))).alias(f"{g}_{n}") for g, e in groups.items() for n, f in (("low", F.min), ("high", F.max))]
    stats = cells.filter("not settled").groupBy("p", "pivot").agg(*bounds, F.count("*").alias("m"))
    owed = {"hu": ("hu", "hs", "vu", "vs"), "hs": ("hu", "vu"), "vu": ("hu", "hs"), "vs": ("hu",)}
    near = {g: " or ".join(f"({o}_low <= d + {THRESHOLD} and {o}_high >= d - {THRESHOLD})" for o in some) for g, some in owed.items()}
    stays = " or ".join(f"(({groups[g]}) and ({e}))" for g, e in near.items())
    return _spread(cells.filter("not settled"), stats, ["p", "pivot"], few).filter(f"m > 1 and coalesce({stays}, false)")


def _blocks() -> F.Column:
    return F.greatest(F.ceil(F.count("*") / HALF_DOCS), F.ceil(F.sum("n") / HALF_SHINGLES)).cast("int")


def _in_blocks(rows: DataFrame, few: bool) -> DataFrame:
    """Regions in blocks, a task for every pair of blocks but for pairs whose documents are all linked with one pivot."""
    sizes = rows.groupBy("p", "linked").agg(_blocks().alias("blocks"))
    both = sizes.groupBy("p").agg(F.coalesce(F.max(F.when(~F.col("linked"), F.col("blocks"))), F.lit(0)).alias("open"), F.coalesce(F.max(F.when(F.col("linked"), F.col("blocks"))), F.lit(0)).alias("tied"))
    dealt = _spread(rows, both.filter("open > 0"), ["p"], few).withColumn("own", F.expr("pmod(xxhash64(x, 1), if(linked, tied, open)) + if(linked, open, 0)").cast("int"))
    other = F.expr("if(linked, sequence(0, open - 1), sequence(0, open + tied - 1))")
    return dealt.withColumn("other", F.explode(other)).select("x", "p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def cut_regions(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Tasks (x, p, i, j) of bounded size for the regions ``pairs`` (x, p, n), and the links (u, v) found on the way."""
    one = lambda rows: rows.select("x", "p", F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = checkpointed(pairs.groupBy("p").agg(_blocks().alias("blocks"), F.count("*").alias("m")).filter("blocks > 2"))
    if large.isEmpty():
        return one(pairs), []
    few = large.count() <= FEW
    rows = checkpointed(_spread(pairs.withColumn("linked", F.lit(False)), large, ["p"], few))
    # The regions that fit a task are all others; they are many, so it is the large ones that are told to the tasks.
    tasks, links = [checkpointed(one(_spread(pairs, large.select("p"), ["p"], few, "left_anti")))], []
    for number in range(ROUNDS):
        drawn = rows.filter(F.expr(f"pmod(xxhash64(x, {number + 2}), m) < {PIVOTS}")).select("x", "p", "blocks")
        drawn = drawn.unionByName(rows.groupBy("p").agg(F.min("x").alias("x"), F.first("blocks").alias("blocks")).select("x", "p", "blocks")).distinct()
        drawn = checkpointed(drawn)
        few = drawn.count() <= FEW  # each region has a pivot, and each cell is a pivot's
        pivots = drawn.join(sets, "x").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("x", "p", "own", "shingles").toDF("x", "q", "at", "shingles")
        members = rows.withColumn("own", F.expr("pmod(xxhash64(x, 1), blocks)").cast("int")).join(sets, "x").select("x", "p", "own", "shingles").toDF("x", "p", "own", "shingles")
        cells = members.groupBy("p", "own").cogroup(pivots.groupBy("q", "at")).applyInArrow(
            _measured, "x long, p long, n int, pivot long, d double, linked boolean, home boolean, settled boolean"
        )
        cells = checkpointed(_spread(cells, rows.groupBy("p").agg(F.first("m").alias("above")), ["p"], few))
        links.append(cells.filter("linked and x <> pivot").select(F.col("x").alias("u"), F.col("pivot").alias("v")))
        opened = _still_open(cells, few).select("x", F.col("p").alias("q"), F.xxhash64("p", "pivot", F.lit(number)).alias("p"), "n", "linked", "above")
        opened = checkpointed(opened)
        last = number + 1 == ROUNDS
        whole = opened.groupBy("q").agg(F.count("*").alias("m"), F.first("above").alias("above"))
        parted = checkpointed(whole.select("q", F.expr(f"m <= {GROWN} * above and {str(not last).lower()}").alias("parted")))
        # Regions that are not parted: blocks, and who is linked with the pivot of the most links.
        counts = cells.filter("linked").groupBy("p", "pivot").count().groupBy("p").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("best"))
        kept = parted.filter("not parted").select(F.col("q").alias("p")).join(counts, "p")
        star = _spread(cells.filter("linked").select("x", "p", "pivot"), kept, ["p"], few).filter("pivot = best").select("x", "p", F.lit(True).alias("star"))
        stuck = _spread(rows.select("x", "p", "n"), kept.select("p"), ["p"], few).join(star, ["x", "p"], "left")
        tasks.append(checkpointed(_in_blocks(checkpointed(stuck.select("x", "p", "n", F.coalesce("star", F.lit(False)).alias("linked"))), few)))
        # Cells of the others: tasks where they fit one, else they are cut again.
        going = _spread(opened.drop("above"), parted.filter("parted").select("q"), ["q"], few).select("x", "p", "n", "linked")
        going = checkpointed(going)
        sizes = going.groupBy("p").agg(_blocks().alias("blocks"), F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("open"))
        sized = checkpointed(_spread(going, sizes.filter("open > 0"), ["p"], few))
        tasks.append(one(sized.filter("blocks <= 2")))
        rows = sized.filter("blocks > 2").select("x", "p", "n", "linked", "blocks", "m")
        if last or rows.isEmpty():
            break
    whole = tasks[0]
    for more in tasks[1:]:
        whole = whole.unionByName(more)
    return whole, links


def _marked(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """(doc_id, n, key, shingles) of every row; the shingles only where the key may be wanted, once in a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in blocks(batches):
            values, ends, keys = shingle_sets(batch.column("text"))
            n = np.diff(ends)
            hits = wanted.has(keys.view(np.int64)) & (n > 0)
            sets: list[bytes | None] = [None] * len(n)
            for i in np.flatnonzero(hits):
                if int(keys[i]) not in seen:
                    seen.add(int(keys[i]))
                    sets[i] = values[ends[i] : ends[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(keys.view(np.int64), mask=n == 0), pa.array(sets, pa.binary())], ["doc_id", "n", "key", "shingles"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, key long, shingles binary")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, key) and, for each key, its component (key, component, component_id, rows)."""
    buckets = dealing_keys(docs.sparkSession, shuffle_partitions(docs.sparkSession))
    counted = count_holders(send_windows(docs, buckets), buckets)
    pairs = checkpointed(label_regions(choose_pivots(counted, buckets), buckets))
    marked = checkpointed(_marked(docs, bitmap_of(pairs.select("x"))))
    sets = marked.filter("shingles is not null").select(F.col("key").alias("x"), "shingles").dropDuplicates(["x"])
    tasks, found = cut_regions(pairs, sets)
    # Rows of blocks repeat a document and take few bytes in a file, but many in memory: no broadcast by the file's size.
    links = tasks.hint("merge").join(sets, "x").groupBy("p", "i", "j").applyInArrow(_region_links, "u long, v long")
    for more in found:
        links = links.unionByName(more)
    connected = components(links.distinct())
    own = marked.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows"))
    own = own.join(connected.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    whole = own.groupBy("component").agg(F.min("_least").alias("component_id"), F.sum("_rows").alias("rows"))
    return marked.select("doc_id", "n", "key"), own.select("key", "component").join(whole, "component")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    rows, classes = _classes(docs)
    linked = rows.filter("n > 0").join(classes.select("key", "component_id"), "key")
    alone = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with one row (smallest doc_id, then text) of each group of linked documents.

    Rows whose set stands alone never move; only possible members of groups are shuffled.
    """
    _, classes = _classes(docs)
    # Names that the rows cannot have, whatever they are called.
    key, near = (f"__{n}_{max(map(len, docs.columns), default=0) * '_'}" for n in ("key", "near"))
    several = checkpointed(classes.filter("rows > 1").select("key", "component"))
    wanted = bitmap_of(several.select("key"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            _, ends, keys = shingle_sets(batch.column("text"))
            hits = wanted.has(keys.view(np.int64)) & (np.diff(ends) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64)), pa.array(hits)], [*names, key, near])

    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType()), T.StructField(near, T.BooleanType())])
    tagged = docs.mapInArrow(run, schema)
    row = [F.col(f"`{n}`") for n in names]
    alone = tagged.filter(~F.col(near)).select(*row)
    groups = tagged.filter(F.col(near)).select(F.col(key).alias("key"), F.struct(*row).alias("row")).join(several, "key", "left").withColumn("component", F.coalesce("component", "key"))
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("row.text"))
    chosen = groups.groupBy("component").agg(F.min_by("row", order).alias("row")).select("row.*")
    return alone.unionByName(chosen)
