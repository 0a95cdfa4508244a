"""Streams that have run to their end against the same functions over batches."""

from pyspark.sql import functions as F

from lendmill.operators.duplicates import first_wins
from lendmill.streaming import challenges, duplicates, windows


def test_request_windows(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 5).alias("tenant"), F.col("ts").cast("timestamp").alias("ts"))
    source.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    done = windows.request_counts(stream, 2, "1 hour", late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    done.awaitTermination(120)
    key = lambda r: (r.tenant, r.begins)
    assert sorted(spark.table("counts").collect(), key=key) == sorted(windows.request_counts(source, 2, "1 hour").collect(), key=key)


def test_challenges(spark, tmp_path):
    rows = [(1, 0, "send"), (1, 60, "wrong"), (1, 70, "right"), (2, 0, "send"), (2, 400, "right"), (3, 0, "send"), *((3, 10 + i, "wrong") for i in range(6)), (4, 5, "right"), (5, 0, "send"), (5, 100, "send"), (5, 350, "right"), (6, 1000, "send")]
    events = spark.createDataFrame([(k, t, i, kind) for i, (k, t, kind) in enumerate(rows)], "key long, t long, seq long, kind string").select("key", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), "seq", "kind")
    batch = {(r.key, r.challenge): r.status for r in challenges.outcomes(events).collect()}
    assert batch == {(1, 1): "VERIFIED", (2, 1): "EXPIRED", (3, 1): "LOCKED", (5, 1): "OPEN", (5, 2): "VERIFIED", (6, 1): "OPEN"}
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    done = challenges.stream_outcomes(stream).writeStream.outputMode("append").format("memory").queryName("codes").trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {(r.key, r.sent - 1_000_000): r.status for r in spark.table("codes").collect()}
    assert got == {(1, 0): "VERIFIED", (2, 0): "EXPIRED", (3, 0): "LOCKED", (5, 0): "REPLACED", (5, 100): "VERIFIED"}


def test_duplicates_by_batches(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    low = docs.selectExpr("percentile(doc_id, 0.5)").first()[0]
    write = duplicates.keep_index(f"{tmp_path}/index", compact_every=1)
    write(docs.filter(F.col("doc_id") <= low), 0)
    write(docs.filter(F.col("doc_id") > low), 1)
    write(docs.filter(F.col("doc_id") > low), 1)  # a batch that runs again
    kinds = lambda rows: {(r.doc_id, r.original_id, r.kind) for r in rows.collect()}
    assert kinds(spark.read.parquet(f"{tmp_path}/index/out")) == kinds(first_wins(docs))
    # All at once as a stream of files, with files that very many rows share.
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = stream.writeStream.foreachBatch(duplicates.keep_index(f"{tmp_path}/again")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    done.awaitTermination(300)
    again = kinds(spark.read.parquet(f"{tmp_path}/again/out"))
    firsts = {i for i, _, kind in again if kind == "New"}
    assert len(again) == docs.count() and len(firsts) == len({i for i, _, k in kinds(first_wins(docs)) if k == "New"}) and {o for _, o, _ in again} == firsts


def plain_index(batches: list[list[tuple]]) -> list[tuple]:
    """The rule, one document after another: three maps, checked strongest first; only firsts are registered."""
    maps, out = [{}, {}, {}], []
    for batch in batches:
        for doc_id, sha, content, image in sorted(batch, key=lambda r: (r[0] is None, r[0] or 0)):
            keys = (sha, content, image)
            hit = next(((m[k], kind) for m, k, kind in zip(maps, keys, duplicates.KINDS, strict=True) if k is not None and k in m), None)
            out.append((doc_id, *(hit or (doc_id, "New"))))
            if hit is None:
                for m, k in zip(maps, keys, strict=True):
                    if k is not None:
                        m.setdefault(k, doc_id)
    return sorted(out, key=str)


def test_index_of_three_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(duplicates, "LEAST", 2)
    long = "Words that are long enough to count as a text of their own. " * 5
    texts = [long, long.upper(), long.replace(" ", "  "), "short", "short", "other", None, "", long + "more"]
    images = {"short": "a", "other": "a", "": "b", None: "b"}
    rows = [(i, texts[i * 7 % 9], images.get(texts[i * 7 % 9])) for i in range(40)] + [(None, "last", None), (41, "lone", None)]
    schema = "doc_id long, text string, image_hash string"
    batches = [[r for r in rows if (r[0] or 0) % 3 == b] for b in range(3)] + [[]]
    index = duplicates.DuplicateIndex(spark, f"{tmp_path}/index")
    got, keys = [], []
    for number, batch in enumerate(batches):
        docs = spark.createDataFrame(batch, schema)
        keys.append([tuple(r)[:4] for r in duplicates.keys_of(docs).collect()])
        got += [tuple(r) for r in index.add(docs, number).collect()]
        if number == 1:
            index.compact()
            assert index.live() == ["c000000002"]
    assert sorted(got, key=str) == plain_index(keys)


def test_index_reads_only_touched_prefixes(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = duplicates.DuplicateIndex(spark, f"{tmp_path}/index")
    index.add(docs, 0)
    one = duplicates._entries(duplicates.keys_of(docs.orderBy("doc_id").limit(1)).select("sha", "content", "image")).select(duplicates._prefix(F.col("key")).alias("p"))
    touched = [r[0] for r in one.distinct().collect()]
    read = index.entries(index.live(), touched)
    assert len(read.inputFiles()) > len(touched)  # before pruning every prefix is listed
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "generation#" in filters and "prefix#" in filters
    assert {r[0] for r in read.select(F.regexp_extract(F.input_file_name(), "prefix=(..)", 1)).distinct().collect()} <= set(touched)
