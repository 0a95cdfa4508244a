"""Operator 7, toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of letters, digits and non-ASCII characters) is the sum of two hashed embeddings, of the whole word and
of its first four bytes. Filters of several widths slide over a document's words, each keeps its maximum over the
whole text, and a logistic layer joins them. A fifth of the training rows (by a hash of the text) sets a threshold for
each language; the language of a text is told from its words alone, by log odds of all training rows' words. A score is
the logistic function of the distance to the threshold, so 0.5 is the threshold everywhere.

Every labelled row that is not held out is learned from. Rows are dealt into shards by a hash of the id and kept on disk as
hashed words. In each round every shard goes through its own rows from the same model, and the shards' changes are averaged:
rows of an embedding by how often a shard used them, so what only one shard has seen counts in full, all else by rows. Word
counts by language are added up over all rows, and cuts are chosen over all rows of that fifth, counted by steps of 1 / CUTS
of the score. The driver holds a model and a row for each language; scoring is one narrow pass over all rows.

Cases: null and empty texts are scored as texts without words; without labelled rows of both labels every score is 0;
equal texts have equal scores, and repeated rows are scored each; a text of any length is scored as a whole, in a block of
its own where it is longer than one; an id that repeats is learned from once for each of its labels, with its smallest text;
an empty table gives no rows; languages beyond the ``tasks.MOST_LABELS`` most frequent ones are learned as one; extra columns of the input are dropped by ``score_toxicity`` and kept by ``clean_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmill.llm.ragged import MARKS, blocks, text_bytes, words
from lendmill.llm.tasks import MOST_LABELS, bitmap_of, dealing_keys, held_out

BUCKETS, SIZE, FILTERS, WIDTHS, PREFIX = 1 << 14, 16, 12, (1, 2, 3), 4
#: Least steps of training: small tables are gone through more often.
STEPS = 1000
#: Labelled rows of a shard, about, and shards at most (beyond, they grow): a group that averages them holds MOST_SHARDS pieces.
SHARD_ROWS, MOST_SHARDS, PIECE = 1 << 13, 512, 512
#: Bytes of hashed words that a task trains on at once, and steps of a score among which thresholds are chosen, in how many steps.
SHARD_BYTES, CUTS, MOST_CUTS = 16 << 20, 64, 1 << 12
PAD = BUCKETS
#: Pad words behind each document, so that no filter reaches the next one, not even from a document without words.
PADS = max(WIDTHS)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of each word (whole, prefix) and offsets by document; pad words end each document."""
    body, offsets = text_bytes(texts)
    _, _, docs, whole, head = words(body, offsets, apart=MARKS, prefix=PREFIX)
    counts = np.bincount(docs, minlength=len(texts)).astype(np.int64)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts + PADS, out=ends[1:])
    at = np.arange(len(docs)) + PADS * docs
    rows = np.full((2, ends[-1]), PAD, np.int64)
    rows[0, at] = whole & np.uint64(BUCKETS - 1)
    rows[1, at] = (head >> np.uint64(20)) & np.uint64(BUCKETS - 1)
    return rows[0], rows[1], ends


def hashed_sample(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a whole sample, block by block: only the hashed words of all texts are held at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = [hashed_words(b.column("text")) for b in blocks(iter([batch]), limit=1 << 19)]
    before = np.cumsum([0, *(p[2][-1] for p in parts[:-1])])
    ends = np.concatenate([[0], *(p[2][1:] + b for p, b in zip(parts, before, strict=True))]).astype(np.int64)
    return np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts]).astype(np.int32), ends


@dataclass
class TextCnn:
    words: np.ndarray
    heads: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    languages: np.ndarray
    thresholds: np.ndarray

    def pooled(self, whole: np.ndarray, head: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each document, by tables of every embedding under every filter position."""
        if not hasattr(self, "_tables"):
            self._tables = [[(self.words @ k, self.heads @ k) for k in bank] for bank in self.filters]
        found = np.empty((len(ends) - 1, FILTERS * len(WIDTHS)), np.float32)
        for b, (width, tables) in enumerate(zip(WIDTHS, self._tables, strict=True)):
            n = len(whole) - width + 1
            total = tables[0][0][whole[:n]]
            total += tables[0][1][head[:n]]
            for j in range(1, width):
                total += tables[j][0][whole[j : n + j]]
                total += tables[j][1][head[j : n + j]]
            # Windows begin at words; of a document without any the first pad stands for "none".
            for i in range(len(ends) - 1):
                part = total[ends[i] : max(ends[i + 1] - PADS, ends[i] + 1)]
                found[i, b * FILTERS : (b + 1) * FILTERS] = part.max(axis=0)
        return np.maximum(found + self.bias, 0)

    def logits(self, texts: pa.Array) -> np.ndarray:
        whole, head, ends = hashed_words(texts)
        raw = self.pooled(whole, head, ends) @ self.out + self.base
        return raw - self.thresholds[self.language(whole, ends)]

    def language(self, whole: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.languages[whole], ends[:-1], axis=0).argmax(axis=1)


def _adam(shape) -> dict:
    return {"m": np.zeros(shape, np.float32), "v": np.zeros(shape, np.float32)}


def _move(value: np.ndarray, grad: np.ndarray, state: dict, rate: float, step: int, rows: np.ndarray | None = None) -> None:
    """An Adam step, on some rows only where they are given."""
    at = slice(None) if rows is None else rows
    state["m"][at] = 0.9 * state["m"][at] + 0.1 * grad
    state["v"][at] = 0.99 * state["v"][at] + 0.01 * grad * grad
    value[at] -= rate * (state["m"][at] / (1 - 0.9**step)) / (np.sqrt(state["v"][at] / (1 - 0.99**step)) + 1e-6)


def begun(seed: int) -> dict[str, np.ndarray]:
    """The parameters from which training begins."""
    rng = np.random.default_rng(seed)
    near = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
    values = {"e1": near(BUCKETS + 1, SIZE), "e2": near(BUCKETS + 1, SIZE), **{f"w{w}": near(w, SIZE, FILTERS, k=0.3) for w in WIDTHS}}
    values["e1"][PAD] = values["e2"][PAD] = 0
    return values | {"bias": np.zeros(FILTERS * len(WIDTHS), np.float32), "out": near(FILTERS * len(WIDTHS), k=0.3), "base": np.zeros(1, np.float32)}


class Learner:
    """Adam on a copy of the parameters; ``used`` counts the rows learned from and the steps that moved each embedding."""

    def __init__(self, values: dict[str, np.ndarray], share: float, seed: int, rate: float = 0.01):
        self.values, self.states = {k: v.copy() for k, v in values.items()}, {k: _adam(v.shape) for k, v in values.items()}
        self.weights = 0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3)
        self.rng, self.rate, self.step, self.rows = np.random.default_rng(seed), rate, 0, 0
        self.used = {k: np.zeros(BUCKETS + 1, np.float32) for k in ("e1", "e2")}

    def learn(self, whole: np.ndarray, head: np.ndarray, ends: np.ndarray, labels: np.ndarray, epochs: int) -> None:
        """Go through some documents so many times."""
        values, move = self.values, lambda k, grad, *rows: _move(values[k], grad, self.states[k], self.rate, self.step, *rows)
        weight, order = np.where(labels > 0, self.weights[1], self.weights[0]).astype(np.float32), np.arange(len(labels))
        self.rows += len(labels)
        for _ in range(epochs):
            self.rng.shuffle(order)
            for some in np.array_split(order, max(1, len(order) // 32)) if len(order) else []:
                self.step += 1
                at = [np.arange(ends[i], ends[i + 1]) for i in some]
                own = np.cumsum([0, *map(len, at)])
                flat = np.concatenate(at)
                x = values["e1"][whole[flat]] + values["e2"][head[flat]]
                tops, peaks = [], []
                for w in WIDTHS:
                    total = sum(x[j : len(x) - w + 1 + j] @ values[f"w{w}"][j] for j in range(w))
                    top = np.stack([total[a : max(b - PADS, a + 1)].argmax(axis=0) + a for a, b in zip(own[:-1], own[1:], strict=True)])
                    tops.append(top)
                    peaks.append(np.take_along_axis(total, top, 0))
                pre = np.concatenate(peaks, axis=1) + values["bias"]
                act = np.maximum(pre, 0) * (self.rng.random(pre.shape) > 0.2) / 0.8
                z = act @ values["out"] + values["base"][0]
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * weight[some] / len(some)
                d_act = dz[:, None] * values["out"] * (pre > 0) * (act > 0) / 0.8
                move("out", act.T @ dz + 1e-4 * values["out"])
                move("base", np.array([dz.sum()], np.float32))
                move("bias", d_act.sum(axis=0))
                dx = np.zeros_like(x)
                for b, w in enumerate(WIDTHS):
                    bank = values[f"w{w}"]
                    d, top, grad = d_act[:, b * FILTERS : (b + 1) * FILTERS], tops[b], np.empty_like(bank)
                    for j in range(w):
                        grad[j] = np.einsum("nfd,nf->df", x[top + j], d)
                        np.add.at(dx, (top + j).ravel(), (d[:, :, None] * bank[j].T).reshape(-1, SIZE))
                    move(f"w{w}", grad)
                moved = np.flatnonzero(np.abs(dx).sum(axis=1))
                for name, index in (("e1", whole), ("e2", head)):
                    rows, inverse = np.unique(index[flat[moved]], return_inverse=True)
                    sums = np.zeros((len(rows), SIZE), np.float32)
                    np.add.at(sums, inverse, dx[moved])
                    sums[rows == PAD] = 0
                    move(name, sums, rows)
                    values[name][PAD] = 0
                    self.used[name][rows] += 1


def modelled(values: dict[str, np.ndarray], languages: np.ndarray) -> TextCnn:
    """A model without thresholds; ``languages`` are the log odds."""
    banks = [values[f"w{w}"] for w in WIDTHS]
    return TextCnn(values["e1"], values["e2"], banks, values["bias"], values["out"], float(values["base"][0]), languages, np.zeros(languages.shape[1], np.float32))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of each hashed word by language, of their counts (hashed words, languages)."""
    counts = (counts + 0.5).astype(np.float32)
    odds = np.log(counts / counts.sum(axis=0))
    odds[PAD] = 0
    return odds.astype(np.float32)


def rounds_of(rows: int, shards: int, epochs: int) -> tuple[int, int]:
    """Rounds and the times that a shard goes through its rows in each; a single shard needs no average."""
    many = max(epochs, min(40, -(-STEPS * 32 * shards // max(1, rows))))
    return (1, many) if shards == 1 else (many, 1)


def train(texts: list[str], labels: np.ndarray, langs: list[str], epochs: int = 5, rate: float = 0.01, seed: int = 11) -> TextCnn | None:
    """Fit on a few texts as on one shard; None if they have not both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    order = sorted(range(len(texts)), key=lambda i: (texts[i], int(labels[i])))  # whatever order they come in
    texts, labels, langs = [texts[i] for i in order], labels[order].astype(np.float32), [langs[i] for i in order]
    whole, head, ends = hashed_sample(texts)
    fold = np.array([hash_fold(t) for t in texts])
    fit, held = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if len(set(labels[fit].tolist())) < 2:
        fit = held = np.arange(len(texts))
    learner = Learner(begun(seed), float(labels[fit].mean()), seed, rate)
    at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in fit])
    learner.learn(whole[at], head[at], np.concatenate([[0], np.cumsum(np.diff(ends)[fit])]), labels[fit], rounds_of(len(fit), 1, epochs)[1])
    names = sorted({x or "" for x in langs})
    counts = np.zeros((BUCKETS + 1, len(names)))
    for i, lang in enumerate(langs):
        np.add.at(counts[:, names.index(lang or "")], whole[ends[i] : ends[i + 1] - PADS], 1)
    model = modelled(learner.values, log_odds(counts))
    raw, group = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i in held:
        own, edge = slice(ends[i], ends[i + 1]), np.array([0, ends[i + 1] - ends[i]])
        raw[i] = (model.pooled(whole[own], head[own], edge) @ model.out + model.base)[0]
        group[i] = model.language(whole[own], edge)[0]
    overall = best_threshold(raw[held], labels[held], 0.0)
    model.thresholds = np.array([best_threshold(raw[held][group[held] == g], labels[held][group[held] == g], overall) for g in range(len(names))], np.float32)
    return model


def hash_fold(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) % 5


def best_threshold(raw: np.ndarray, labels: np.ndarray, otherwise: float, least: int = 5) -> float:
    """The cut with the highest F1 for label 1, shrunk to the midpoint between its neighbours."""
    if labels.sum() < least or (1 - labels).sum() < least:
        return otherwise
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + labels.sum())
    k = int(f1.argmax())
    below = raw[order[k + 1]] if k + 1 < len(raw) else raw[order[k]] - 1
    return float((raw[order[k]] + below) / 2)


def shard_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(shard, place, doc_id, label, fold, lang, whole, head) of every labelled row that is not held out, and the number of shards.

    A partition holds the rows of its shards in the order of (shard, place). Only documents that a bitmap of the ids lets
    through are shuffled for the join, and of these the hashed words for the shards.
    """
    spark = docs.sparkSession
    ids = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
    shards = max(1, min(MOST_SHARDS, -(-ids.count() // SHARD_ROWS)))
    known = bitmap_of(ids.select(F.xxhash64("doc_id").alias("key")))

    @F.pandas_udf("boolean")
    def perhaps(keys: pd.Series) -> pd.Series:
        return pd.Series(known.has(keys.to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            whole, head, ends = hashed_words(batch.column("text"))
            packed = [pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(x.astype(np.int16))]) for x in (whole, head)]
            fold = pa.array([hash_fold(t) for t in batch.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "label", "lang")), fold, *packed], ["doc_id", "label", "lang", "fold", "whole", "head"])

    texts = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).alias("t"))
    found = texts.filter(perhaps(F.xxhash64("doc_id"))).join(ids.distinct(), "doc_id").groupBy("doc_id", "label").agg(F.min("t").alias("t")).select("doc_id", "label", "t.*")
    hashed = found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, lang string, fold int, whole binary, head binary")
    place = F.xxhash64("doc_id", F.lit(7))
    keys = F.array(*(F.lit(int(k)) for k in dealing_keys(spark, shards)))
    hashed = hashed.withColumns({"place": place, "shard": F.element_at(keys, (F.pmod(place, F.lit(shards)) + 1).cast("int"))})
    return hashed.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id", "label"), shards


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and offsets of a block of such rows."""
    (whole, offsets), (head, _) = (text_bytes(batch.column(k)) for k in ("whole", "head"))
    return whole.view(np.int16).astype(np.int64), head.view(np.int16).astype(np.int64), offsets // 2


def averaged(rows: DataFrame, values: dict[str, np.ndarray], share: float, epochs: int, rate: float, seed: int) -> dict[str, np.ndarray]:
    """The parameters after a round: every shard learns from its rows, and its changes are averaged."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, learner = None, None
        for batch in blocks(batches, "whole", SHARD_BYTES):
            shard, labels = batch.column("shard").to_numpy(), batch.column("label").to_numpy().astype(np.float32)
            whole, head, ends = _words(batch)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if shard[a] != own:
                    if learner is not None:
                        yield changes(own, learner)
                    own, learner = shard[a], Learner(values, share, seed + int(shard[a]), rate)
                part = slice(ends[a], ends[b])
                learner.learn(whole[part], head[part], ends[a : b + 1] - ends[a], labels[a:b], epochs)
        if learner is not None:
            yield changes(own, learner)

    def changes(shard: int, learner: Learner) -> pa.RecordBatch:
        out = []
        kinds = {"name": pa.string(), "at": pa.int32(), "shard": pa.int32(), "used": pa.binary(), "moved": pa.binary()}
        for name, value in learner.values.items():
            moved = (value - values[name]).reshape(len(value), -1)
            used = learner.used.get(name, np.full(len(value), learner.rows, np.float32))
            out += [(name, a, int(shard), used[a : a + PIECE].tobytes(), moved[a : a + PIECE].tobytes()) for a in range(0, len(value), PIECE) if used[a : a + PIECE].any()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    def mean(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("shard")
        used = [np.frombuffer(x.as_py(), np.float32).astype(float) for x in pieces["used"]]
        moved = [np.frombuffer(x.as_py(), np.float32).reshape(len(u), -1) for x, u in zip(pieces["moved"], used, strict=True)]
        total = sum(u[:, None] * m for u, m in zip(used, moved, strict=True)) / np.maximum(sum(used), 1)[:, None]
        return pa.table({"name": pieces["name"][:1], "at": pieces["at"][:1], "moved": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    made = rows.select("shard", "label", "whole", "head").mapInArrow(learned, "name string, at int, shard int, used binary, moved binary")
    values = {k: v.copy() for k, v in values.items()}
    for r in made.groupBy("name", "at").applyInArrow(mean, "name string, at int, moved binary").collect():
        some = values[r.name][r.at : r.at + PIECE]
        some += np.frombuffer(r.moved, np.float32).reshape(some.shape)
    return values


def word_counts(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Counts of (hashed word, language) over all rows; a language without a name counts as the last one."""
    places = {n: i for i, n in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in blocks(batches, "whole", SHARD_BYTES):
            whole, _, ends = _words(batch)
            at = np.array([places.get(x, len(places) - 1) for x in batch.column("lang").to_pylist()])
            owner = np.repeat(at, np.diff(ends))
            for lang in np.unique(at):
                found[lang] = found.get(lang, 0) + np.bincount(whole[owner == lang], minlength=BUCKETS + 1)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([int(k) for k in found], pa.int32()), pa.array([v.astype(np.int64).tobytes() for v in found.values()], pa.binary())], ["lang", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((BUCKETS + 1, len(names)), np.int64)
    for r in rows.select("lang", "whole", "head").mapInArrow(counted, "lang int, counts binary").groupBy("lang").applyInArrow(added, "lang int, counts binary").collect():
        counts[:, r.lang] = np.frombuffer(r.counts, np.int64)
    counts[PAD] = 0
    return counts


def thresholds(rows: DataFrame, model: TextCnn, least: int = 5) -> np.ndarray:
    """For each language the cut with the highest F1 over all rows, between neighbouring steps; of all languages where it has too few."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "whole"):
            whole, head, ends = _words(batch)
            raw = (model.pooled(whole, head, ends) @ model.out + model.base).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(model.language(whole, ends), pa.int32()), pa.array(raw), batch.column("label")], ["g", "raw", "label"])

    c = F.col
    step = F.greatest(F.lit(-MOST_CUTS), F.least(F.lit(MOST_CUTS), F.floor(c("raw") * CUTS))).cast("int").alias("step")
    steps = rows.select("label", "whole", "head").mapInArrow(judged, "g int, raw double, label int").groupBy("g", step).agg(F.count("*").alias("n"), F.sum("label").alias("hits"), F.min("raw").alias("low"), F.max("raw").alias("high"))
    both = steps.withColumn("g", F.explode(F.array("g", F.lit(-1)))).groupBy("g", "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    group, down = Window.partitionBy("g"), Window.partitionBy("g").orderBy(F.desc("step"))
    seen = both.withColumns({"toxic": F.sum("hits").over(group), "all": F.sum("n").over(group), "caught": F.sum("hits").over(down), "taken": F.sum("n").over(down), "below": F.lead("high").over(down)})
    f1 = 2 * c("caught") / (c("taken") + c("toxic"))
    cut = (c("low") + F.coalesce("below", c("low") - 1)) / 2
    found = seen.filter((c("toxic") >= least) & (c("all") - c("toxic") >= least)).groupBy("g").agg(F.max_by(cut, F.struct(f1, "step")).alias("cut")).collect()
    cuts = {r.g: r.cut for r in found}
    return np.array([cuts.get(g, cuts.get(-1, 0.0)) for g in range(len(model.thresholds))], np.float32)


def fit_toxicity(docs: DataFrame, labels: DataFrame, epochs: int = 5, rate: float = 0.01, seed: int = 11) -> TextCnn | None:
    """Train from all rows that are not held out; ``labels`` has doc_id and toxic. None without rows of both labels."""
    rows, shards = shard_rows(docs, labels)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        fold, label = F.col("fold") > 0, F.col("label")
        n, hits, fit_n, fit_hits = (x or 0 for x in rows.agg(F.count("*"), F.sum(label), F.sum(fold.cast("int")), F.sum(F.when(fold, label))).first())
        if not 0 < hits < n:
            return None
        fit, held = rows.filter(fold), rows.filter(~fold)
        if not 0 < fit_hits < fit_n:
            fit = held = rows
            fit_n, fit_hits = n, hits
        values = begun(seed)
        rounds, times = rounds_of(fit_n, shards, epochs)
        for k in range(rounds):
            values = averaged(fit, values, fit_hits / fit_n, times, rate, seed + 1000 * k)
        names = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()]
        names = sorted(names) + [None] * (len(names) == MOST_LABELS)
        model = modelled(values, log_odds(word_counts(rows, names)))
        model.thresholds = thresholds(held, model)
        return model
    finally:
        rows.unpersist()


def scores(model: TextCnn | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(model.logits(texts).astype(np.float64), -30, 30)))


def score_toxicity(docs: DataFrame, model: TextCnn | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    read = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return read.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean_rows(docs: DataFrame, model: TextCnn | None) -> DataFrame:
    """The rows of ``docs`` that the model does not take for toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(scores(model, batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
