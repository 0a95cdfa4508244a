"""The Jaccard join against brute force, and the pipeline's shape."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lendmill.llm import jaccard_join as jj
from lendmill.llm.tasks import components


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups_of(rows):
    """Shingle sets, and for each row the first row that it is connected with, by comparing all pairs."""
    sets, parent = [word_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    return sets, parent


def brute(rows):
    """(doc_id, n_shingles, component_id)."""
    sets, parent = groups_of(rows)
    least = {}
    for (doc_id, _), s, p in zip(rows, sets, parent, strict=True):
        if doc_id is not None:
            least[p] = min(least.get(p, doc_id), doc_id)
    return [(rows[i][0], len(sets[i]), least.get(parent[i])) for i in range(len(rows))]


def edited(words, own, share):
    return " ".join(own.choice("pqr") * 4 + str(own.randint(0, 10**6)) if own.random() < share else w for w in words)


def family_rows(seed):
    own = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for f in range(12):
        base = [f"w{own.randint(0, 4000)}" for _ in range(own.choice((6, 12, 45, 60, 70, 150, 400)))]
        for _ in range(own.randint(1, 14)):
            words = edited(base, own, own.choice((0, 0.01, 0.03, 0.05, 0.08))).split()
            if own.random() < 0.5:
                words = words + passage
            rows.append((len(rows), " ".join(words)))
    own.shuffle(rows)
    return rows


def test_odd_rows(odd, rows, nothing):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(odd).collect())
    assert got == Counter(brute([r[:2] for r in rows]))
    assert jj.jaccard_components(nothing).count() == 0
    kept = jj.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(groups_of([r[:2] for r in rows])[1]))


def test_links_without_a_common_shingle_in_the_part_are_found(spark):
    """Pairs of long documents whose common shingles all lie above PART of the hash space, among usual ones."""
    own, low, high = random.Random(4), [], []
    import pyarrow as pa

    while len(high) < 200:  # sequences of five words by where the hash of their shingle lies
        texts = [" ".join(f"v{own.randint(0, 10**6)}" for _ in range(5)) for _ in range(500)]
        values, _, _ = jj.shingle_sets(pa.array(texts))
        for t in texts:
            (value,), _, _ = jj.shingle_sets(pa.array([t]))
            (low if value < np.uint64(int(jj.PART * 2**64)) else high).append(t)
    sets = lambda some: jj.shingle_sets(pa.array(some))
    values = {t: int(sets([t])[0][0]) for t in low[:80] + high[:200]}
    made = {1: high[:90] + low[:9], 2: high[:90] + low[9:18], 3: high[100:190], 4: high[100:185]}
    real, docs = jj.shingle_sets, spark.createDataFrame([(i, str(i)) for i in made], "doc_id long, text string")
    crafted = {str(i): np.array(sorted(values[t] for t in some), np.uint64) for i, some in made.items()}
    entries: dict = {}

    def shingle_sets(texts):
        found = [crafted[t] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        return np.concatenate(found), ends, np.array([np.uint64(int(t) * 2) for t in texts.to_pylist()])

    # The window sender is run in this process on crafted sets; what it sends decides which documents can meet.
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter([pa.RecordBatch.from_pydict({"text": ["1", "2", "3", "4"]})])))

    jj.shingle_sets = shingle_sets
    try:
        for batch in jj.send_windows(Docs(), np.array([0], np.int32)):
            for row in batch.to_pylist():
                if row["kind"] == jj.ENTRIES:
                    refs = np.frombuffer(row["c"], np.uint64)
                    for s, i in zip(np.frombuffer(row["a"], np.uint64).tolist(), np.frombuffer(row["b"], np.uint16).tolist(), strict=True):
                        entries.setdefault(s, set()).add(int(refs[i]) & ~1)
    finally:
        jj.shingle_sets = real
    met = {frozenset(p) for some in entries.values() for p in [(a, b) for a in some for b in some if a < b]}
    assert docs.count() == 4 and {frozenset((2, 4)), frozenset((6, 8))} <= met


@pytest.mark.parametrize("seed", range(2))
def test_large_regions_are_cut_by_pivots(spark, seed, monkeypatch):
    """One region of several families: stars, two separate clusters, chains, and documents in between."""
    monkeypatch.setattr(jj, "HALF_DOCS", 6)
    monkeypatch.setattr(jj, "PIVOTS", (2, 4)[seed])
    monkeypatch.setattr(jj, "GROWN", (1.5, 9.0)[seed])
    own = np.random.default_rng(seed)
    shared, sets = own.integers(0, 2**62, 30, dtype=np.uint64), []
    for _ in range(4):
        base = np.r_[shared, own.integers(0, 2**62, 60, dtype=np.uint64)]
        for _ in range(25):
            base = base if own.random() < 0.7 else np.r_[base[3:], own.integers(0, 2**62, 3, dtype=np.uint64)]
            keep = base[own.random(len(base)) > own.choice((0.0, 0.03, 0.1, 0.2))]
            sets.append(np.unique(np.r_[keep, own.integers(0, 2**62, int(own.integers(0, 4)), dtype=np.uint64)]))
    pairs = spark.createDataFrame([(i, 7, len(s)) for i, s in enumerate(sets)] + [(1000 + i, 8, 3) for i in range(2)], "x long, p long, n int")
    shingles = [(i, bytearray(s.tobytes())) for i, s in enumerate(sets)] + [(1000 + i, bytearray(np.arange(3, dtype=np.uint64).tobytes())) for i in range(2)]
    held = spark.createDataFrame(shingles, "x long, shingles binary")
    tasks, found = jj.cut_regions(pairs, held)
    assert found and tasks.groupBy("p", "i", "j").count().agg({"count": "max"}).first()[0] < 60
    links = tasks.join(held, "x").groupBy("p", "i", "j").applyInArrow(jj._region_links, "u long, v long")
    for more in found:
        links = links.unionByName(more)
    got = {r.node: r.component for r in components(links).collect()}
    whole, parent = [set(s.tolist()) for s in sets], list(range(len(sets)))
    for i, a in enumerate(whole):
        for j in range(i):
            common = len(a & whole[j])
            if 100 * common >= 75 * (len(a) + len(whole[j]) - common) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    assert [got.get(i, i) for i in range(len(sets))] == parent and got[1001] == 1000


def broadcast_rows(spark, since):
    """Rows of every broadcast of the executions after ``since``, and the last execution's number."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, found, last = spark._jsparkSession.sharedState().statusStore(), [], since
    listed = store.executionsList()
    for number in (listed.apply(i).executionId() for i in range(listed.size())):
        last = max(last, number)
        if number > since:
            metrics, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if node.name() == "BroadcastExchange":
                    own = (node.metrics().apply(i) for i in range(node.metrics().size()))
                    told = [metrics.get(m.accumulatorId()) for m in own if m.name() == "number of output rows"]
                    found += [int(t.get().replace(",", "")) for t in told if t.isDefined()]
    return found, last


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_no_row_for_each_region_and_partition_is_broadcast(spark, few, monkeypatch):
    """a large region among many small ones; those are not repeated for each partition in the driver."""
    monkeypatch.setattr(jj, "HALF_DOCS", 6)
    monkeypatch.setattr(jj, "FEW", few)
    shared = np.arange(50, dtype=np.uint64)
    sets = {i: np.r_[shared, np.uint64(1000 + i)] for i in range(40)} | {1000 + i: np.arange(3, dtype=np.uint64) + np.uint64(10**6 + 10 * (i // 2)) for i in range(1000)}
    pairs = spark.createDataFrame([(i, 7 if i < 1000 else 1000 + i // 2, len(s)) for i, s in sets.items()], "x long, p long, n int")
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "x long, shingles binary")
    _, before = broadcast_rows(spark, -1)
    tasks, found = jj.cut_regions(pairs, held)
    small = sorted((r.x, r.p) for r in tasks.filter("x >= 1000").collect())
    assert small == sorted((i, 1000 + i // 2) for i in sets if i >= 1000)
    rows, after = broadcast_rows(spark, before)
    assert after > before and max(rows, default=0) <= 100
    links = tasks.join(held, "x").groupBy("p", "i", "j").applyInArrow(jj._region_links, "u long, v long")
    for more in found:
        links = links.unionByName(more)
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 40)} | {i: i - 1 for i in range(1001, 2000, 2)}


def test_text_ids_and_names_that_clash(spark):
    docs = spark.createDataFrame([("b", "one two three", 1, 2, 3), ("a", "One two three", 1, 2, 3), ("c", None, 1, 2, 3)], "doc_id string, text string, __key int, __near int, __x int")
    assert sorted(r.component_id for r in jj.jaccard_components(docs).collect()) == ["a", "a", "c"]
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ["a", "c"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_with_shared_passages(spark, seed, monkeypatch):
    if seed == 3:  # tiny blocks and tasks: every region is split, every shingle streams
        monkeypatch.setattr(jj, "HALF_DOCS", 3)
    rows = family_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in jj.jaccard_components(docs).collect()) == sorted(brute(rows))


@pytest.mark.parametrize("seed", range(6))
def test_region_join_is_exact(seed):
    own = np.random.default_rng(seed)
    sets = []
    for _ in range(8):
        base = own.integers(0, 2**62, own.choice((5, 40, 120)), dtype=np.uint64)
        for _ in range(int(own.integers(1, 25))):
            keep = base[own.random(len(base)) > own.choice((0.0, 0.05, 0.12, 0.3))]
            sets.append(np.unique(np.r_[keep, own.integers(0, 2**62, int(own.integers(0, 6)), dtype=np.uint64)]) if len(keep) else base)
    found = jj.region_join(sets)
    whole = [set(s.tolist()) for s in sets]
    parent = list(range(len(sets)))
    for i, a in enumerate(whole):
        for j in range(i):
            common = len(a & whole[j])
            if 100 * common >= 75 * (len(a) + len(whole[j]) - common) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    assert found.tolist() == parent


def test_hot_values_stream(monkeypatch):
    monkeypatch.setattr(jj, "HOT", 4)
    held = jj._Entries()
    held.limit = 8
    assert held.add(np.array([1] * 6 + [2], np.uint64), np.arange(7, dtype=np.uint64)) is None
    held.add(np.array([1, 3], np.uint64), np.array([7, 8], np.uint64))
    gone = held.overflow()
    assert gone[1].tolist() == [0, 1, 2, 3, 4, 5, 7] and held.add(np.array([1, 2], np.uint64), np.array([9, 9], np.uint64))[1].tolist() == [9]
    assert sorted(held.all()[0].tolist()) == [2, 2, 3]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(11, 61)} == {10} and {found[200 + i] for i in range(50)} == {100} and found[300] == 5 and 7 not in found
