"""Operator 9, language identification: a byte convolutional network over fixed-length windows.

The whole text is cut into windows of a fixed number of bytes (lower-cased A-Z); each window goes through filters of
several widths over byte embeddings, a maximum over its positions and a softmax layer. A document's probabilities are
the softmax of the mean of its windows' outputs, weighted by their bytes. Filters are applied as sums of tables, one
row for each byte value under each filter position, so a window costs a few table reads a byte.

Trained in numpy on a bounded sample (at most ``per_label`` rows of each language, ``WINDOWS`` windows of each).

Cases: a null text and a text without a letter (``str.isalpha``) give ``und`` with score 0; with no labelled row all
texts do; equal texts have equal results, and repeated rows are predicted each; a text of any length is read as a whole, in
a block of its own where it is longer than one; equal probabilities go to the first language in text order; of more than
``tasks.MOST_LABELS`` languages (1000) the most frequent ones are learned; an empty table gives no rows; rows without a label
are predicted and not trained on; extra columns are dropped by ``identify`` and kept by ``known_language_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmill.llm.ragged import LOWER, blocks, text_bytes
from lendmill.llm.tasks import held_out, training_rows

WINDOW, SIZE, FILTERS, WIDTHS = 128, 8, 12, (2, 3, 4)
PER_LABEL, WINDOWS = 400, 6
PAD = 256
UNKNOWN = "und"


def windows(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each text (rows of WINDOW byte values, the last padded), their texts and their lengths."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(WINDOW, sizes[owner] - number * WINDOW)
    at = (offsets[:-1][owner] + number * WINDOW)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    rows = np.full(at.shape, PAD, np.int16)
    rows[inside] = LOWER[body][at[inside]]
    return rows, owner, length


@dataclass
class ByteCnn:
    names: list[str]
    embedding: np.ndarray
    banks: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        """One row of class outputs for each window."""
        pooled = []
        for bank in self.banks:
            tables = [self.embedding @ k for k in bank]
            n = WINDOW - len(bank) + 1
            total = np.take(tables[0], rows[:, :n], axis=0)
            for j in range(1, len(bank)):
                total += np.take(tables[j], rows[:, j : n + j], axis=0)
            pooled.append(total.max(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.base

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        body, offsets = text_bytes(texts)
        rows, owner, length = windows(body, offsets)
        total = np.zeros((len(texts), len(self.names)))
        for a in range(0, len(rows), 256):  # parts that fit in a CPU's cache
            some = slice(a, a + 256)
            np.add.at(total, owner[some], self.outputs(rows[some]) * np.maximum(length[some], 1)[:, None])
        total /= np.maximum(np.diff(offsets), 1)[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 5) -> ByteCnn | None:
    """Fit on a bounded sample of labelled texts; None without any."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    order = sorted(range(len(texts)), key=lambda i: (texts[i], langs[i]))  # the sample comes in no fixed order
    names = sorted(set(langs))
    kept, labels = [], []
    for i in order:
        body, offsets = text_bytes(pa.array([texts[i]], pa.string()))
        rows, _, _ = windows(body, offsets)
        some = rows[rng.permutation(len(rows))[:WINDOWS]]
        kept.append(some)
        labels.append(np.full(len(some), names.index(langs[i])))
    x, y = np.concatenate(kept), np.concatenate(labels)
    values = {
        "e": rng.normal(0, 0.3, (PAD + 1, SIZE)), **{f"w{w}": rng.normal(0, 0.3, (w, SIZE, FILTERS)) for w in WIDTHS},
        "bias": np.zeros(FILTERS * len(WIDTHS)), "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))), "base": np.zeros(len(names)),
    }
    values = {k: v.astype(np.float32) for k, v in values.items()}
    values["e"][PAD] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in values.items()}, {k: np.zeros_like(v) for k, v in values.items()}, 0
    for _ in range(max(epochs, min(60, -(-300 * 64 // len(x))))):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            step += 1
            rows, grad = x[some], {}
            emb = values["e"][rows]
            peaks, tops = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                total = sum(emb[:, j : n + j] @ values[f"w{w}"][j] for j in range(w))
                top = total.argmax(axis=1)
                tops.append(top)
                peaks.append(np.take_along_axis(total, top[:, None], 1)[:, 0])
            pre = np.concatenate(peaks, axis=1) + values["bias"]
            act = np.maximum(pre, 0)
            z = act @ values["out"] + values["base"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(len(some)), y[some]] -= 1
            dz /= len(some)
            grad["out"], grad["base"] = act.T @ dz + 1e-4 * values["out"], dz.sum(axis=0)
            d_act = (dz @ values["out"].T) * (pre > 0)
            grad["bias"], grad["e"] = d_act.sum(axis=0), np.zeros_like(values["e"])
            line = np.arange(len(some))[:, None]
            for k, w in enumerate(WIDTHS):
                d, bank = d_act[:, k * FILTERS : (k + 1) * FILTERS], values[f"w{w}"]
                grad[f"w{w}"] = np.empty_like(bank)
                for j in range(w):
                    byte = rows[line, tops[k] + j]
                    grad[f"w{w}"][j] = np.einsum("nfd,nf->df", values["e"][byte], d)
                    np.add.at(grad["e"], byte.ravel(), (d[:, :, None] * bank[j].T).reshape(-1, SIZE))
            grad["e"][PAD] = 0
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return ByteCnn(names, values["e"], [values[f"w{w}"] for w in WIDTHS], values["bias"], values["out"], values["base"])


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter; only texts without an ASCII letter are looked at one by one."""
    body, offsets = text_bytes(texts)
    small = LOWER[body]
    ascii_letters = np.r_[0, np.cumsum((small >= 97) & (small <= 122))]
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


def predict(model: ByteCnn | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and its probability for each text of a block."""
    names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if model is None or not len(texts):
        return names, score
    found = model.probabilities(texts)
    told = has_letter(texts)
    names[told] = np.array(model.names, object)[found.argmax(axis=1)][told]
    score[told] = found.max(axis=1)[told]
    return names, score


def fit_language_id(docs: DataFrame, per_label: int = PER_LABEL) -> ByteCnn | None:
    """Train from rows with a language that are not held out."""
    ids = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang")
    sample = training_rows(docs.select("doc_id", "text"), ids, "lang", per_label)
    return train(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            names, score = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return read.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def known_language_rows(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(predict(model, batch.column("text"))[0] != UNKNOWN))

    return docs.mapInArrow(run, docs.schema)
