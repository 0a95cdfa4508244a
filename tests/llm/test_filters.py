"""URL filters, main text, toxicity, language and mixing."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendmill.llm import html_text, language_id, mixing, toxicity, url_filter

URLS = [
    (1, "http://Blog.Example.NET/en/x?y#z"), (2, "https://a.example.net/de/"), (3, "https://example.com/de/x"), (4, "http://x.org/fr/1"), (5, "http://x.org/fr"), (6, None), (7, "no scheme"),
    (8, "https://net"), (9, "https://net/"), (10, "http://notexample.net.org/"), (11, "http://spam-farm.example.org/en/"), (12, "http://user@sub.spam-farm.example.org/fr/q"), (13, "://x.net/a"),
    (14, "http://a.net?u=http://b.org/fr/"), (9, "https://net/"), (None, "http://É.NET/"), (15, "http://./"), (16, "http://a\n.net/b"),
]


def tuples(frame: pd.DataFrame) -> list[tuple]:
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls_as_in_sql(spark, broadcast, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    pages = spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame(url_filter.ENTRIES, url_filter.ENTRY_SCHEMA)
    got = url_filter.judge_urls(pages, listed).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(URLS, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    assert tuples(got) == tuples(con.sql(url_filter.SQL).df())
    by = {r.page_id: r for r in got.itertuples()}
    assert by[1].rule == "example.net/en/" and by[2].rule == "net/" and by[5].rule is None and by[11].verdict == "block" and by[12].rule == "org/fr/" and by[6].host == ""
    assert set(url_filter.judge_urls(pages, listed.limit(0)).toPandas()["verdict"]) == {"allow"}


def test_false_positives_of_the_filter_go(spark):
    many = [(f"h{i}.test", "/", "block", False) for i in range(500)]
    pages = spark.createDataFrame([(i, f"http://h{i}.test/a") for i in range(3000)], "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(many, url_filter.ENTRY_SCHEMA))
    assert got.filter("verdict = 'block'").count() == 500
    blocks = url_filter.bloom_blocks(spark.createDataFrame(many, url_filter.ENTRY_SCHEMA), 64)
    assert blocks.count() <= 64 and blocks.filter(F.col("mask") == 0).count() == 0


def test_entries_with_long_paths_are_found(spark):
    many = [("long.test", "/" + "a" * n, "block", False) for n in range(1, 1300)] + [("deep.test", "/" + "b" * 1500, "block", False)]
    pages = spark.createDataFrame([(1, "http://deep.test/" + "b" * 1501), (2, "http://deep.test/" + "b" * 1499), (3, "http://x.long.test/" + "a" * 1299)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, spark.createDataFrame(many, url_filter.ENTRY_SCHEMA)).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "allow", "block"] and len(got[3].listed) == len("long.test/") + 1299


def test_hosts_of_very_many_labels_and_hot_urls(spark, monkeypatch):
    """A host's suffixes are bounded by the list's; every URL counts as hot, so that all verdicts are spread."""
    monkeypatch.setattr(url_filter, "HOT", 10**9)
    monkeypatch.setattr(url_filter, "LEAST", 1)
    deep = ".".join(["a"] * 100_000)
    urls = [(1, f"http://{deep}.spam-farm.example.org/x"), (2, f"http://{deep}.net/" + "p" * 1_000_000)] + [(10 + i, "http://x.example.net/en/") for i in range(200)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(url_filter.ENTRIES, url_filter.ENTRY_SCHEMA)).collect()}
    assert len(got) == 202 and got[1].verdict == "block" and got[1].rule is None and got[2].rule == "net/" and {got[10 + i].rule for i in range(200)} == {"example.net/en/"}


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header class="site">Site</header><div class="cookie-notice">We use cookies, many of them.</div>
<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Head &amp; line</h1><p>First   para with <b>bold</b> text, and more.<p>Second&nbsp;para, long enough; surely so.<ul><li>one<li>two</ul><blockquote>Said so.</blockquote></article>
<aside>Side</aside><div class="ad">Buy this now, it is cheap.</div><form>Name <input></form><section id="comments"><p>Nice post! I liked it a lot, thanks for it.</p></section><!-- c --><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Head & line\nFirst para with bold text, and more.\nSecond para, long enough; surely so.\none\ntwo\nSaid so."
    for page, want in [(None, ""), ("", ""), ("<p>", ""), ("plain < text", "plain < text"), ("<div><p>a<br>b</p></div>", "a b"), ("<p>x</p><script>never</script", "x"), ("<p>kept <unfinished", "kept"), ("&lt;b&gt; &#233;", "<b> é")]:
        assert html_text.main_text(page) == want
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", long, "x"), (1, "u", PAGE, "x")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == sorted(len(html_text.main_text(r[2])) for r in rows)


LONG = "A paragraph, as long as paragraphs are; it has words, marks, and more words. " * 8


def test_all_that_lies_in_the_article_stays():
    table = "<table><tr><th>Year<th>Sum<tr><td>2020<td>12<tr><td><p>2021</p><td>13</table>"
    links = "<a href=x>Links</a><br>" * 12
    for tag in ("article", "main", "div"):
        got = html_text.main_text(f"<body><div><b>{links}</b></div><{tag}><p>{LONG}</p>{table}<div><ul><li>one<li>two</ul></div><p>{LONG}</p></{tag}></body>")
        assert got.split("\n")[1:-1] == ["Year Sum", "2020 12", "2021", "13", "one", "two"] and "Links" not in got
    assert html_text.main_text(f"<body><p>{LONG}</p><table><tr><td>2020<td>12</table></body>").endswith("\n2020 12")
    cells = html_text.main_text(f"<body><table><tr><td><ul>{"<li>Home" * 12}</ul><td><p>{LONG}</p><p>End.</p></table></body>")
    assert "Home" not in cells and cells.endswith("End.")
    two = html_text.main_text(f"<body><div><b>{links}</b></div><div><div><p>{LONG}</p></div><div>Short</div><div><p>{LONG}</p></div></div></body>")
    assert two.split("\n")[1] == "Short" and "Links" not in two


def test_quotes_begin_values_only():
    page = f"<article><p>{LONG}</p><a href=it's>link</a><p title = 'a > b'>It's here.</p><p class=\"x\">Last, isn't it?</p></article>"
    assert html_text.main_text(page).split("\n")[1:] == ["link", "It's here.", "Last, isn't it?"]


@pytest.mark.parametrize("fragment", ['<h2 id="side-effects">H</h2>', '<h2 id="related-work">H</h2>', '<h2 id="social-policy">H</h2>', '<section id="discussion"><p>H</p></section>', '<p class="ad-hoc">H</p>', "<p title=don't>H</p>", '<p title="x>H</p>'])
def test_names_inside_the_article_drop_nothing(fragment):
    got = html_text.main_text(f"<body><nav>Menu</nav><article><p>{LONG}</p>{fragment}<p>{LONG}</p><p>End.</p></article><footer>Foot</footer></body>")
    assert got.split("\n") == [LONG.strip(), "H", LONG.strip(), "End."]


def test_pages_without_telling_markup():
    menu = "<ul><li>Home<li>About<li>Contact</ul>"
    flat = html_text.main_text(f"<body>{menu}<p>{LONG}</p><p>{LONG}</p><div>Subscribe</div><div>© 2020 me</div></body>")
    assert flat.split("\n") == [LONG.strip()] * 2
    links = "<ul><li><a href=x>Home</a><li><a href=y>News</a></ul>"
    wrapped = html_text.main_text(f"<body><div>{links}<h1>Title</h1><p>{LONG}</p><h2>x</h2><p>{LONG}</p><ul><li>one</ul><h3>More</h3>{links}<div>Subscribe.</div></div><div>Copyright me</div></body>")
    assert wrapped.split("\n") == ["Title", LONG.strip(), "x", LONG.strip(), "one"]


def test_deep_and_unmatched_markup_takes_linear_time():
    import time

    for n in (50_000,):
        for page in ("<div>" * n + LONG, "<b>" * n + LONG, "<b>" * n + "<p>x" * 100 + LONG, "<div><i>" * n + "</b>" * n + LONG, "<ul><li>" * n + LONG, '<a b="' * n + LONG, "<p a='" * n):
            began = time.process_time()
            html_text.main_text(page)
            assert time.process_time() - began < 10


def plain_content(page):
    """Content nodes by string paths and plain loops, for pages of well-formed elements."""
    import re

    path, nodes = [], []
    for part in re.split(r"(<[^>]*>)", page):
        if part.startswith("</"):
            path.pop()
        elif part.startswith("<"):
            path.append(part[1:-1].replace(" class=", ".").replace('"', ""))
        elif part.strip():
            nodes.append(("/".join(path), part))
    total: dict = {}
    for p, text in nodes:
        some = total.setdefault(p, [0, 0, 0])
        some[0], some[1], some[2] = some[0] + 1, some[1] + len("".join(text.split())), some[2] + sum(c in ".,;:!?" for c in text)
    ratio = {p: n / k * (1 + m / k) for p, (k, n, m) in total.items()}
    near = [1.0, np.exp(-1 / 8), np.exp(-1 / 2)]
    smoothed: dict = {p: 0.0 for p in total}
    for i, (p, _) in enumerate(nodes):
        around = [(near[abs(d)], ratio[nodes[i + d][0]]) for d in range(-2, 3) if 0 <= i + d < len(nodes)]
        smoothed[p] += sum(w * r for w, r in around) / sum(w for w, _ in around)
    score = {p: (ratio[p] * smoothed[p] / total[p][0]) ** 0.5 for p in total}
    limit = min(0.5 * sum(score[p] * total[p][1] for p in total) / sum(t[1] for t in total.values()), max(score.values()))
    return [text for p, text in nodes if score[p] >= limit - 1e-9]


@pytest.mark.parametrize("seed", range(40))
def test_content_nodes_as_by_a_plain_model(seed):
    import random

    own = random.Random(seed)
    word = lambda: "".join(own.choices("abcdefgh", k=own.randint(1, 9))) + own.choice(["", "", "", ",", "."])

    def part(depth):
        if depth == 0 or own.random() < 0.3:
            tag = own.choice(["p", "span", "li", "div", 'div class="x"', "b"])
            return f"<{tag}>{' '.join(word() for _ in range(own.choice((2, 3, 60, 90))))}</{tag.split()[0]}>"
        tag = own.choice(["div", "section", 'div class="y"', "ul"])
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(own.randint(1, 5)))}</{tag.split()[0]}>"

    page = f"<body>{''.join(part(3) for _ in range(4))}</body>"
    found = html_text.parse(page)
    content = html_text.content_nodes(found)
    assert [found.nodes[i][2] for i in np.flatnonzero(content)] == plain_content(page)


def test_toxicity_held_out(spark, odd, nothing, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs.join(labels, "doc_id"), model).join(labels, "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / max(1, (got.predicted == 1).sum()) > 0.8 and hit / (got.toxic == 1).sum() > 0.75
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    kept = toxicity.clean_rows(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in scored)
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.fit_toxicity(docs, labels.limit(0)) is None and {r.score for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}


def test_language_held_out(spark, odd, nothing, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language_id.fit_language_id(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    found = language_id.identify(odd, model).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[4].lang_pred == by[5].lang_pred == by[6].lang_pred == by[11].lang_pred == "und" != by[12].lang_pred
    kept = language_id.known_language_rows(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in found)
    assert language_id.identify(nothing, model).count() == 0 and {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_many_cells_are_raked_by_joins_alike(odd, monkeypatch):
    few, many = [], []
    for most, found in ((100_000, few), (1, many)):
        monkeypatch.setattr(mixing, "MOST_CELLS", most)
        found.extend(mixing.with_probabilities(odd, rounds=3).select("doc_id", "_topic", F.round("probability", 6)).collect())
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_mixing_as_in_sql(odd, rows, nothing):
    got = mixing.mixed_report(odd).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    want = con.sql(mixing.SQL).df()
    for frame in (got, want):
        frame["doc_id"], frame["probability"] = frame["doc_id"].astype("Int64"), frame["probability"].round(5)
    assert tuples(got) == tuples(want)
    kept = mixing.mix(odd)
    assert kept.columns == odd.columns and kept.count() == len(got)
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("most", [100_000, 1])
def test_the_sample_meets_its_targets(spark, most, monkeypatch):
    """A third of the tokens in one source, many small groups: what the sampled cells hold in expectation."""
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    texts = [(i, " ".join(["word"] * (20 + i % 7)), ("en", "de", "fr")[i % 7 % 3], "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    found = mixing.with_probabilities(docs).select("_source", "_lang", "_tokens", "probability").toPandas()
    assert found["probability"].max() <= 1 + 1e-9 and found["probability"].max() > 0.999
    found["kept"] = found["_tokens"] * found["probability"]
    for m in ("_source", "_lang"):
        sums = found.groupby(m)[["_tokens", "kept"]].sum()
        want = (sums["_tokens"] / sums["_tokens"].sum()) ** mixing.POWER
        assert np.allclose(sums["kept"] / sums["kept"].sum(), want / want.sum(), atol=1e-3)


def test_the_sampled_tokens_meet_the_margins(spark, sf):
    """What mix() keeps of sf0.1, not its expectation: every margin of 1 % or more of the tokens within one point."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet")
    found = mixing.with_probabilities(docs).select("doc_id", "_source", "_lang", "_topic", "_tokens").toPandas()
    kept = mixing.mixed_report(docs).select("doc_id").toPandas()["doc_id"]
    sample = found[found["doc_id"].isin(kept)]
    assert 0.5 < len(sample) / len(found) < 0.7
    for m in ("_source", "_lang", "_topic"):
        want = (found.groupby(m)["_tokens"].sum() / found["_tokens"].sum()) ** mixing.POWER
        have = sample.groupby(m)["_tokens"].sum() / sample["_tokens"].sum()
        assert ((want / want.sum() - have.reindex(want.index).fillna(0)).abs() < 0.01).all(), m


def test_raking_meets_given_targets():
    cells = pd.DataFrame({"source": list("aabb"), "lang": list("xyxy"), "topic": list("tttt"), "tokens": [100, 50, 30, 20]})
    targets = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}}
    weight = mixing.rake(cells, targets, rounds=50)
    assert np.allclose(weight.sum(), 200) and np.isclose(weight[:2].sum(), 80) and np.isclose(weight[[0, 2]].sum(), 100)
    p = mixing.calibrated(cells["tokens"].to_numpy(), weight / cells["tokens"].to_numpy(), 0.5)
    assert np.isclose((p * cells["tokens"]).sum(), 100) and p.max() <= 1


def test_windows_cover_every_byte():
    texts = pa.array(["", "a" * 127, "b" * 128, "c" * 129])
    from lendmill.llm.ragged import text_bytes

    rows, owner, length = language_id.windows(*text_bytes(texts))
    assert np.bincount(owner, weights=length).tolist() == [0, 127, 128, 129] and (rows != language_id.PAD).sum() == 384
