"""Source divergence and ranked search against SQL on odd rows, and the bit-sliced arithmetic against plain integers."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lendmill.llm import divergence, lexical

from .conftest import prose


def same(got: pd.DataFrame, want: pd.DataFrame) -> bool:
    plain = lambda f: sorted((tuple(None if pd.isna(v) else v for v in r) for r in f[sorted(f.columns)].itertuples(index=False)), key=str)
    return sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.fixture(scope="module")
def many(spark, rows):
    """The odd rows, and documents of a few words that most sources hold, in three languages; one source has a third of all."""
    more = []
    for i in range(400):
        words = prose(i % 7, 30).split() + ["Straße", "ÄRGER", "it's", "x2y", "日本語", "don"][: i % 7]
        more.append((1000 + i // 2, " ".join(words), ("en", "de", None)[i % 3], "hot" if i % 3 == 0 else f"s{i % 5}", 1, 1, 0.1, "z"))
    more += [(5000 + i, "1 2 3", "xx", f"s{i}", 1, 1, 0.1, "z") for i in range(3)]
    return spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long, component long, probability double, value string").repartition(5)


def sql(text: str, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.astype({c: "Int64" for c in frame.columns if c.endswith("_id")}))
    return con.sql(text).df()


@pytest.mark.parametrize("small", [False, True])
def test_divergence_as_in_sql(spark, many, nothing, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "ENTRIES", 20)
        monkeypatch.setattr(divergence, "CELLS", 8)
    got = divergence.divergence_report(many).toPandas()
    assert same(got, sql(divergence.SQL, documents=many.toPandas()))
    assert set(got["lang"]) >= {"", "en", "xx"} and got[got["lang"] == "xx"]["value"].tolist() == [0] * 6
    assert divergence.divergence_report(nothing).count() == 0


def test_run_lengths_over_batches(spark, monkeypatch):
    """Runs that cross batches add up once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("en", w, s, d, 1, 2) for w in ("a", "b") for s in ("x", "y") for d in range(7)]
        dealt = spark.createDataFrame(rows, "lang string, term string, source string, document long, docs long, count long").coalesce(1)
        assert sorted(map(tuple, divergence.run_lengths(dealt).collect())) == [("en", w, s, 7, 14) for w in ("a", "b") for s in ("x", "y")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_are_exact_for_great_counts():
    own = np.random.default_rng(1)
    total = own.integers(1, 9 * 10**15, 1000)
    count = (total * own.random(1000)).astype(np.int64) - 5
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]
    assert divergence.shares(np.array([5]), np.array([10])).tolist() == [10**9 + 1]


@pytest.mark.parametrize("small", [False, True])
def test_search_as_in_sql(spark, many, nothing, monkeypatch, small):
    if small:
        for name, value in (("PIECE", 7), ("BLOCK", 20), ("ITEMS", 2), ("MOST_PAIRS", 40), ("PIECE_POSTINGS", 50)):
            monkeypatch.setattr(lexical, name, value)
    asked = [prose(i, 12) for i in range(7)] + ["it's x2y Straße STRASSE don don don", "日本語 " * 3000, "", None, "!!", prose(3, 12), "1234 3 3 3"]
    items = spark.createDataFrame([(i % 12, t, 1) for i, t in enumerate(asked)], "item_id long, text string, rank int").repartition(3)
    got = lexical.ranked_search(many, items).toPandas()
    assert same(got, sql(lexical.SQL, documents=many.toPandas(), benchmark=items.toPandas()))
    assert lexical.ranked_search(nothing, items).count() == 0 and lexical.ranked_search(many, items.limit(0)).count() == 0
    assert lexical.ranked_search(many, items, k=3).groupBy("item_id").count().agg({"count": "max"}).first()[0] <= 6


@pytest.mark.parametrize("seed", range(8))
def test_sums_and_top_of_bit_slices(seed):
    own = np.random.default_rng(seed)
    n = int(own.integers(1, 300))
    lanes, total = -(-n // 64), np.zeros(n, object)
    adder = lexical.Adder(48, lanes)
    for _ in range(int(own.integers(1, 40))):
        docs = np.flatnonzero(own.random(n) < own.random())
        if len(docs):
            values, times = own.integers(0, 1 << int(own.integers(1, 30)), len(docs)), int(own.integers(1, 200))
            values[0] += 1
            adder.add(lexical.slices_of(docs, values, lanes), times)
            total[docs] += values.astype(object) * times
    for k in (1, 10, n):
        want = sorted(((s, i) for i, s in enumerate(total.tolist()) if s), key=lambda t: (-t[0], t[1]))[:k]
        again = lexical.Adder(48, lanes)
        again.sum, again.carry = adder.sum.copy(), adder.carry.copy()
        assert sorted(lexical.top(again.slices(), k), key=lambda t: (-t[0], t[1])) == want
