"""Label alignment against a plain loop over random boxes, and odd reports."""

import random

from pyspark.sql import functions as F

from lendmill.operators import reports

WORDS = ["DATE", "Date Opened", "WRITTEN OFF", "(TOTAL)", "WRITTEN-OFF (TOTAL)", ": 12", "x", "Total: 9", "OFF", "CONSUMER NAME", "Name of loan", "name", ":", "|", "report date", "a b", "NAME: Q"]
KEYS = ["DATE", "WRITTEN OFF (TOTAL)", "CONSUMER NAME", "NAME:"]


def clean(text):
    for c in "\n\r-:":
        text = text.replace(c, " ")
    return text.upper()


def plain(elements, key):
    """The stated rule, step by step, over (seq, x0, y0, x1, y1, text)."""
    tokens = list(dict.fromkeys(key.replace("-", " ").replace(":", " ").split()))
    holds = lambda e: any(t in clean(e[5]) for t in tokens)
    best = None
    for s in elements:
        words = clean(s[5])
        if not holds(s) or key == "DATE" and any(w in words for w in reports.NOT_A_DATE) or ("CONSUMER" in key or "NAME" in key) and any(w in words for w in reports.NOT_A_NAME):
            continue
        group, top, bottom = [s], s[2], s[4]
        for e in elements:
            if e is not s and holds(e) and e[2] >= s[2] - 2 and abs(e[1] - s[1]) < 15 and e[4] >= top - 25 and e[2] <= bottom + 25:
                group.append(e)
                top, bottom = min(top, e[2]), max(bottom, e[4])
        kept, seen = [], set()
        for e in sorted(group, key=lambda e: e[2]):
            fresh = {t for t in tokens if t in clean(e[5])} - seen
            if fresh or not kept:
                kept.append(e)
                seen |= fresh
        top, bottom = min(e[2] for e in kept), max(e[4] for e in kept)
        score = len(seen) * 100 - (bottom - top) * 0.1 - max(sum(len(e[5]) for e in kept) - len(key), 0) * 0.5
        if best is None or score > best[0] + 1e-9:
            best = (score, kept, top, bottom)
    if best is None or best[0] < 50:
        return None
    score, kept, top, bottom = best
    inline = kept[0][5].partition(":")[2].strip()
    if inline and len(inline) < 80 and "ACCOUNT" not in inline.upper():
        return inline
    right = max(e[3] for e in kept)
    level = lambda e: min(e[4], bottom) - max(e[2], top) > 0 or e[2] >= top and e[4] <= bottom
    values = sorted((e for e in elements if e[1] >= right - 5 and e not in kept and e[5].strip() not in (":", "|") and level(e)), key=lambda e: e[1])
    values = sorted((e for e in values if e[1] - values[0][1] < 30), key=lambda e: e[2])
    texts = [e[5].strip() for e in values]
    if texts:
        texts[0] = texts[0].lstrip(":").strip()
    found = " ".join(t for t in texts if t)
    if found:
        return found
    label = kept[0]
    for e in elements:
        if label[4] <= e[2] <= label[4] + 15 and e[1] < label[3] and e[3] > label[1] and e[4] - e[2] < (label[4] - label[2]) * 2.2:
            return e[5].strip().lstrip(":").strip() or None
    return None


def test_alignment_as_a_plain_loop(spark):
    rng, docs = random.Random(5), {}
    for doc in range(150):
        docs[doc] = [(i, float(rng.choice([0, 5, 12, 60, 90, 100])), (y := float(rng.randrange(0, 120, 3))), 0.0, y + rng.choice([8.0, 10.0, 30.0]), rng.choice(WORDS)) for i in range(rng.randrange(1, 14))]
        docs[doc] = [(i, x, y, x + rng.choice([20.0, 50.0]), b, t) for i, x, y, _, b, t in docs[doc]]
    rows = [(d, *e) for d, found in docs.items() for e in found]
    frame = spark.createDataFrame(rows, "doc_id long, seq long, x0 double, y0 double, x1 double, y1 double, text string")
    found = reports.aligned_values(reports.with_elements(frame, "doc_id"), F.array(*map(F.lit, KEYS))).collect()
    got = {(r.doc_id, r.key): r.value for r in found}
    want = {(d, k): v for d, e in docs.items() for k in KEYS if (v := plain(e, k))}
    assert got == want
    assert len(got) > 100 and all(0.5 <= r.confidence <= 0.99 for r in found)


def test_reports_without_text_or_tables(spark):
    frame = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0, ""), (2, 0, None, None, None, None, "Score 712"), (3, 0, 0.0, 0.0, 9.0, 9.0, None)], "doc_id long, seq long, x0 double, y0 double, x1 double, y1 double, text string")
    docs = reports.with_elements(frame, "doc_id")
    assert {r.doc_id: r.score for r in reports.scores(docs).collect()} == {1: 0, 2: 712}
    assert {r.consumer_name for r in reports.metadata_and_identity(docs).collect()} == {reports.NO_NAME}
    assert reports.enquiries(docs).count() == reports.addresses(docs).count() == reports.employment(docs).count() == 0
    assert reports.scores(docs.limit(0)).count() == 0


def test_image_hash_is_lengths_data_and_count(spark):
    import hashlib

    from lendmill.operators.duplicates import file_identity, image_hash

    big, small = bytes(range(256)) * 3, b"x"
    images = spark.createDataFrame([(1, 7, bytearray(small)), (1, 2, bytearray(big)), (2, 1, bytearray(b"")), (3, 1, None)], "file_id long, object_no long, data binary")
    low = lambda n: n.to_bytes(8, "little")
    want = {1: hashlib.sha256(low(768) + big + low(1) + small + low(2)).hexdigest(), 2: hashlib.sha256(low(0) + low(1)).hexdigest()}
    assert {r.file_id: r.image_hash for r in image_hash(images).collect()} == want
    files = spark.createDataFrame([(1, "a" * 300), (2, "scan"), (3, None)], "file_id long, text string")
    assert {r.file_id: r.image_hash for r in file_identity(files, images).collect()} == {1: None, 2: want[2], 3: None}


def test_margins_keep_critical_and_single_texts(spark):
    from lendmill.operators.layout import without_margins

    rows = [
        (1, 1, 0, 10.0, "Bank of X, p. 1"), (1, 2, 1, 10.0, "Bank of X, p. 22"), (1, 1, 2, 10.0, "Account 1"), (1, 2, 3, 10.0, "Account 2"), (1, 1, 4, 790.0, "once only"), (1, 1, 5, 400.0, "Bank of X, p. 3"),
        (1, 1, 6, 790.0, "ab1"), (1, 2, 7, 790.0, "ab2"), (2, 1, 0, 10.0, "twice"), (2, 1, 1, 12.0, "twice"), (2, 1, 2, 10.0, "Page 3 of 9"), (2, 1, 3, 10.0, None), (3, 1, 0, None, "confidential"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, page int, seq long, y0 double, text string").withColumn("page_height", F.lit(842.0))
    kept = {(r.doc_id, r.seq) for r in without_margins(frame).collect()}
    assert kept == {(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 0), (2, 1), (2, 3), (3, 0)}
