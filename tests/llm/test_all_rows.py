"""Training of the toxicity classifier learns from every labelled row that is not held out."""

import random
import zlib

import numpy as np
import pyarrow as pa

from lendmill.llm import toxicity

from .conftest import prose


def test_model_languages_and_thresholds_are_of_all_rows(spark, monkeypatch):
    """More rows of a label than the 2,500 that were drawn once; every tenth has a word of its own."""
    monkeypatch.setattr(toxicity, "STEPS", 1)
    own, rows = random.Random(4), []
    for i in range(5200):
        toxic, lang = int(i % 4 == 0), ("en", "de", None)[i % 3]
        text = f"{prose(i % 50, 6)} {'vile' if toxic and own.random() < 0.9 else 'kind'} {lang} w{i if i % 10 == 0 else 1}"
        rows.append((i, text, lang, toxic))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(7, "zz later than the other text of this id", "fr", )], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(99_999, 1), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, epochs=2)
    read = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    names = sorted({r[2] or "" for r in read})
    counts = np.zeros((toxicity.BUCKETS + 1, len(names)))
    for _, text, lang, _ in read:
        whole, _, ends = toxicity.hashed_words(pa.array([text]))
        np.add.at(counts[:, names.index(lang or "")], whole[: ends[1] - toxicity.PADS], 1)
    assert np.allclose(model.languages, toxicity.log_odds(counts), atol=1e-5)
    held = [r for r in read if toxicity.hash_fold(r[1]) == 0]
    whole, head, ends = toxicity.hashed_words(pa.array([r[1] for r in held]))
    raw, group = model.pooled(whole, head, ends) @ model.out + model.base, model.language(whole, ends)
    toxic = np.array([r[3] for r in held])
    f1 = lambda cut, some: 2 * ((raw >= cut) & (toxic == 1) & some).sum() / ((raw >= cut)[some].sum() + toxic[some].sum())
    for g in range(len(names)):
        best = max(f1(cut, group == g) for cut in raw[group == g])
        assert f1(model.thresholds[g], group == g) >= best - 0.01
    # Words that one shard alone has met count too, and another order of the rows changes nothing.
    start = toxicity.begun(11)["e1"]
    rare = [toxicity.hashed_words(pa.array([f"w{r[0]}"]))[0][0] for r in read if r[0] % 10 == 0 and toxicity.hash_fold(r[1])]
    assert (np.abs(model.words[rare] - start[rare]).max(axis=1) > 0).mean() > 0.9
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000)
    several = toxicity.fit_toxicity(docs, labels, epochs=2)
    again = toxicity.fit_toxicity(docs.orderBy("text"), labels.orderBy("toxic"), epochs=2)
    assert np.array_equal(several.words, again.words) and np.array_equal(several.thresholds, again.thresholds)
    assert np.array_equal(several.languages, model.languages) and (np.abs(several.words[rare] - start[rare]).max(axis=1) > 0).mean() > 0.9
    for found in (model, several):
        whole, head, ends = toxicity.hashed_words(pa.array([r[1] for r in rows]))
        said = found.pooled(whole, head, ends) @ found.out + found.base >= found.thresholds[found.language(whole, ends)]
        assert (said == np.array(["vile" in r[1] for r in rows])).mean() > 0.97
