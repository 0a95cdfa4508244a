"""Plain forward passes of the two convolutional networks, word by word and byte by byte, and the pipeline's stages on odd rows."""

import math
import random

import numpy as np
import pyarrow as pa

from lendmill.llm import language_id, toxicity

from .conftest import odd_rows, prose


def texts() -> list[str]:
    found = [r[1] or "" for r in odd_rows()][:16]
    return [t[:3000] for t in found] + ["", "a", "one two", "Ünï cödé wörds in a text", "x" * 127, "y" * 128, "z" * 129, "A-b c_d; e.f"]


def test_text_network_word_by_word():
    own = random.Random(1)
    samples = [prose(own.randint(0, 9), own.randint(1, 60)) + (" badword" if i % 2 else "") for i in range(60)]
    model = toxicity.train(samples, np.array([i % 2 for i in range(60)]), [("en", "de")[i % 3 == 0] for i in range(60)], epochs=1)
    got = toxicity.scores(model, pa.array(texts(), pa.string()))
    for text, score in zip(texts(), got, strict=True):
        whole, head, ends = toxicity.hashed_words(pa.array([text], pa.string()))
        vectors = [model.words[w].astype(float) + model.heads[h] for w, h in zip(whole, head, strict=True)]
        first = max(len(vectors) - toxicity.PADS, 1)
        peaks = []
        for width, bank in zip(toxicity.WIDTHS, model.filters, strict=True):
            for f in range(toxicity.FILTERS):
                peaks.append(max(sum(float(vectors[i + j] @ bank[j][:, f]) for j in range(width)) for i in range(first)))
        raw = sum(max(p + b, 0.0) * o for p, b, o in zip(peaks, model.bias, np.ravel(model.out), strict=True)) + float(np.ravel(model.base)[0])
        odds = [sum(float(model.languages[w][k]) for w in whole) for k in range(model.languages.shape[1])]
        assert abs(1 / (1 + math.exp(-(raw - model.thresholds[odds.index(max(odds))]))) - score) < 1e-3, text


def test_texts_without_words_do_not_look_at_their_neighbours():
    model = toxicity.train(["good words here", "bad words here"] * 10, np.array([0, 1] * 10), ["en"] * 20, epochs=1)
    alone = toxicity.scores(model, pa.array([""], pa.string()))[0]
    for some in (["", "bad bad bad"], ["bad", "", "!!", None], [None], ["good", "..."]):
        got = toxicity.scores(model, pa.array(some, pa.string()))
        assert all(abs(s - alone) < 1e-6 for s, t in zip(got, some, strict=True) if not (t or "").isalpha() and " " not in (t or ""))


def test_byte_network_byte_by_byte():
    own = random.Random(2)
    samples = [prose(own.randint(0, 9), own.randint(1, 60)) + (" é" if i % 2 else "") for i in range(40)]
    model = language_id.train(samples, [("en", "fr")[i % 2] for i in range(40)], epochs=1)
    got = model.probabilities(pa.array(texts(), pa.string()))
    for text, shares in zip(texts(), got, strict=True):
        body = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total, many = np.zeros(len(model.names)), max(1, -(-len(body) // language_id.WINDOW))
        for n in range(many):
            window = list(body[n * language_id.WINDOW : (n + 1) * language_id.WINDOW])
            size = max(len(window), 1)
            window += [language_id.PAD] * (language_id.WINDOW - len(window))
            peaks = []
            for bank in model.banks:
                at = [sum(model.embedding[window[i + j]].astype(float) @ bank[j] for j in range(len(bank))) for i in range(language_id.WINDOW - len(bank) + 1)]
                peaks.append(np.max(at, axis=0))
            total += (np.maximum(np.concatenate(peaks) + model.bias, 0) @ model.out + model.base) * size
        total /= max(len(body), 1)
        want = np.exp(total - total.max())
        assert np.allclose(want / want.sum(), shares, atol=1e-3), text[:50]


def test_stages_on_odd_rows_and_an_empty_table(spark, sf, odd, nothing, rows, tmp_path):
    import corpus_pipeline as cp

    docs, empty = odd, nothing
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != cp.STAGES[-1][0]:
            assert after.columns == docs.columns, name
            assert set(after.select("doc_id", "text").collect()) <= set(docs.select("doc_id", "text").collect()), name
        else:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
        stage(spark, empty, sf).write.parquet(f"{tmp_path}/{name}-of-nothing")
        empty = spark.read.parquet(f"{tmp_path}/{name}-of-nothing")
        assert empty.count() == 0, name
        if name == "language_id":
            assert after.filter("text is null or text = ''").count() == 0
        docs = after
