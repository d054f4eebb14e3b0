"""Classifiers on held-out labels, HTML extraction, and the pipeline stage by stage."""

import html as entities
import os
import re
import zlib

import numpy as np
import time

import pytest

import corpus_pipeline
from linetriage.llm import html, learning, linededup, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def against_labels(spark, name, label, divisor, rest):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % divisor == rest) and 0 <= r.score <= 1 for i, r in rows.items())
    truth = [(r[label], rows[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    return [(t, r) for t, r in truth if r.held_out]


@needs_data
def test_quality_on_held_out_labels(spark):
    seen = against_labels(spark, "op2_quality", "quality", 3, 1)
    assert np.mean([t == r.predicted for t, r in seen]) > 0.95


@needs_data
def test_toxicity_on_held_out_labels(spark):
    seen = against_labels(spark, "op5_toxicity", "toxic", 4, 2)
    assert np.mean([t == r.predicted for t, r in seen]) > 0.85
    assert np.mean([r.predicted for t, r in seen if t]) > 0.5 and np.mean([r.predicted for t, r in seen if not t]) < 0.1


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_both_labels(spark, documents, module, label):
    docs = documents(["a", "", None, "x y " * 5000, "same", "same"])
    for rows in ([], [(0, 1), (1, 1), (None, 0), (4, 7)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        got = module.score(docs, module.fit(docs, labels)).collect()
        assert len(got) == 6 and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    assert module.score(docs.limit(0), module.fit(docs, labels)).collect() == []


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_depend_on_the_text_alone(spark, documents, module, label):
    bad = "shout " if label == "toxic" else "SHOUT!!! "
    texts = [("calm words here and there " * 5) + (bad if i % 2 else "") for i in range(60)]
    docs = documents(texts)
    value = (lambda i: i % 2) if label == "toxic" else (lambda i: 1 - i % 2)
    model = module.fit(docs, spark.createDataFrame([(i, value(i)) for i in range(60)], f"doc_id long, {label} int"))
    rows = module.score(docs.withColumn("doc_id", docs.doc_id + 1000).withColumnRenamed("lang", "quality"), model).collect()
    assert len({round(r.score, 12) for r in rows if r.doc_id % 2}) == 1
    assert len({round(r.score, 12) for r in rows if r.doc_id % 2 == 0}) == 1
    assert {r.predicted for r in rows if r.doc_id % 2} != {r.predicted for r in rows if r.doc_id % 2 == 0}


def test_logistic_fit_is_stationary():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    penalty = np.full(4, 0.5)
    w = learning.logistic(x, y, penalty)
    assert np.abs(x.T @ (learning.sigmoid(x @ w) - y) + penalty * w).max() < 1e-3


def test_quantile_counts_every_row(spark):
    scores = spark.range(1000).selectExpr("id / 1000d as score")
    assert quality.quantile_of(scores, 0.25) == 0.25 and quality.quantile_of(scores, 0.0) == 0.0
    assert quality.quantile_of(scores.limit(0), 0.3) == 0.0


def test_rejected_documents_go_whatever_their_share(spark, documents, tmp_path):
    good = [(i, f"Plain words make sentence {i}, and more of them follow. So it goes on for {i * 7} lines.") for i in range(180)]
    bad = [(1000 + i, f"%%% ### {i} $$$ &&& *** " * (1 + i % 9)) for i in range(420)]  # 20 of them have labels
    documents(good + bad).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad[:20]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in queries.op2_quality(spark, str(tmp_path)).collect()}
    assert sum(p == 0 for p in predicted.values()) > 300
    for share in (600, 420):  # all documents, and none that stays
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where(f"doc_id >= {0 if share == 600 else 1000}")
        model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
        kept = {r.doc_id for r in quality.passing(docs, model, quality.cut_at(docs, model)).collect()}
        assert kept == {r.doc_id for r in docs.collect() if predicted[r.doc_id]}


PAGES = {
    "marked": ("<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='ad'>Buy</div>"
               "<article><h1>Head &amp; line</h1><p>One  two\n three<p><b>Bold</b> text.<br></p><aside>Side</aside><p>A &lt; B</p>"
               "<div class='comments'><p>Nice post</p></div></article><footer>&copy; me</footer><script>var a='</p>';</script>",
               "Head & line\nOne two three\nBold text.\nA < B"),
    "unmarked": ("<body><div id=menu><a href=x>Home</a> <a href=y>News</a></div><div><p>" + "some long words " * 20 + "</p><p>short</p><p>"
                 + "other long words " * 20 + "</p></div><div class='sidebar'>" + "side words " * 30 + "</div><form>Name</form><div>Bye</div>",
                 ("some long words " * 20).strip() + "\nshort\n" + ("other long words " * 20).strip() + "\nBye"),
    "cookie": ("<div class='cookie-notice'><p>" + "we use cookies " * 30 + "</p></div><main><p>Short.</p></main>", "Short."),
    "empty": ("", ""), "blank": (" \n ", ""), "comment only": ("<!-- x --", ""), "no text": ("<article></article><p>out</p>", "out"),
    "unclosed": ("<article><p>a<p>b<script>x", "a\nb"),
}


def test_main_text_of_small_pages():
    for name, (page, want) in PAGES.items():
        if name == "no text":  # too little text outside of an empty article
            want = ""
        assert html.main_text(page) == want, name


def test_windows_decide_on_pages_with_articles():
    story = [f"{'dense story words ' * 12}number {i}" for i in range(6)]
    plain = "<div>" + "".join(f"<p>{p}</p>" for p in story) + "</div>"
    card = "<article><h3>Teaser</h3><p>Some thirty characters of text</p></article>"
    # The story stands in plain elements; article or main hold teaser cards or a short box.
    assert html.main_text(f"<body>{plain}{card * 3}</body>") == "\n".join(story)
    assert html.main_text(f"<body>{card}{plain}{card}</body>") == "\n".join(story)
    assert html.main_text(f"<body><main><p>Short box</p></main>{plain}</body>") == "\n".join(story)
    # Thinner text than that of the article does not surge beside it, nor does text under the least length.
    assert html.main_text(f"<body><div>{'imprint words ' * 20}</div><article>{plain}</article></body>") == "\n".join(story)
    assert html.main_text("<body><article><p>Short</p></article><div>Some plain words outside</div></body>") == "Short"
    # What is set aside in an article makes no dive, and short articles beside a long one stay.
    gap = "<aside>" + "<p>aside</p>" * 5 + "</aside>"
    assert html.main_text(f"<article>{plain}{gap}<p>End</p></article><article>More</article>") == "\n".join([*story, "End", "More"])


def test_names_inside_an_article_set_aside_only_what_is_clear():
    kept = (
        "<div class='entry-header'><h1>Head</h1></div>", "<div class='post-header'><h1>Head</h1></div>", "<h2 id='related-work'>Work</h2>",
        "<h2 id=search>Search</h2>", "<section id='notice'><p>Notice</p></section>", "<div class='side by side'><p>Pair</p></div>",
        "<section aria-label='Search'><p>Find</p></section>", "<section id='comments'><p>On comments</p></section>",
        "<h2 id='ads'>Ads</h2>", "<p title='the hidden truth'>Truth</p>", "<p data-id='share'>Part</p>", "<code class='hljs-comment'># x</code>")
    gone = (
        "<nav>Gone</nav>", "<aside>Gone</aside>", "<form>Gone</form>", "<footer>Gone</footer>", "<div class='ad'>Gone</div>",
        "<div id='ad-slot-3'>Gone</div>", "<ins class='adsbygoogle'>Gone</ins>", "<div id='comments' class='comments-area'>Gone</div>",
        "<ol class='comment-list'><li>Gone</li></ol>", "<div class='social-share-buttons'>Gone</div>", "<div class='share'>Gone</div>",
        "<div role='navigation'>Gone</div>", "<p hidden>Gone</p>", "<p style='display: none'>Gone</p>", "<p aria-hidden='true'>Gone</p>")
    for tag in ("article", "main"):
        for piece in kept:
            inner = re.sub("<[^>]*>", "", piece)
            assert html.main_text(f"<{tag}><p>First</p>{piece}<p>Last</p></{tag}>") == f"First\n{inner}\nLast" or (
                piece.startswith("<code") and inner in html.main_text(f"<{tag}>{piece}</{tag}>")), piece
        for piece in gone:
            assert html.main_text(f"<{tag}><p>First</p>{piece}<p>Last</p></{tag}>") == "First\nLast", piece
    long = "plain words " * 20
    assert "Related" in html.main_text(f"<div><p>{long}</p><h2 id='related-work'>Related</h2><p>{long}</p></div>")


def test_pages_table_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x</article>"), (3, "v", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (1, 0), (3, 5 * 20_000 - 1)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@needs_data
def test_articles_of_the_given_pages(spark):
    got = {r.page_id: r.text for r in queries.op4_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


@needs_data
def test_pipeline_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(after)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            assert {labels[d].quality for d in gone if d in labels} == {0}
            assert all(labels[d].quality == 1 for d in after if d in labels)
        if name == "toxicity":
            assert np.mean([labels[d].toxic for d in gone if d in labels]) > 0.9
        if name == "line_dedup":
            texts = [before[d].text for d in sorted(before)]
            seen = {d: t for d, t in zip(sorted(before), _line_dedup(texts))}
            assert {d: r.text for d, r in after.items()} == {d: t for d, t in seen.items() if t.split() or not before[d].text.split()}
        if name == "ngram_jaccard":
            assert set(after) == _representatives(before)
            assert all(after[d] == before[d] for d in after)
    assert {r.doc_id for r in docs.collect()} == set(before)


def _line_dedup(texts):
    first, gone = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        for f, digest, a, b in linededup.fingerprints(t):
            if first.setdefault((f, digest), (d, a, b)) < (d, a, b):
                gone[d] |= set(range(a, b + 1))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def _representatives(rows):
    found, by, up = {}, {}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[d].text.translate({i: i + 32 for i in range(65, 91)}))
        found[d] = {tuple(words)} if 0 < len(words) < 5 else set(zip(*(words[i:] for i in range(5))))
        up[d], counts = d, {}
        for g in found[d]:
            for e in by.get(g, ()):
                counts[e] = counts.get(e, 0) + 1
            by.setdefault(g, []).append(d)
        for e, n in counts.items():
            if 100 * n >= 80 * (len(found[d]) + len(found[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d for d in found if root(d) == d}


def test_pipeline_on_empty_and_odd_tables(spark, documents, tmp_path):
    rows = [(0, "plain words " * 9), (1, None), (2, ""), (3, "plain words " * 9), (4, "z " * 30_000), (None, "no id")]
    for name, table in (("odd", documents(rows)), ("none", documents([]))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} == ({0, 1, 2, 4, None} if name == "odd" else set())


@pytest.mark.parametrize("unit", [
    "<a ", "<div class='a", '<div class="a', "<!-- ", "<script>", "<script", "</script ", "<p title='>", '<a href="x>', "<!", "</",
    "<title>x</title", "<textarea></textarea x", "<a t=\"x>\" ", "<p title=don't>it's ", "<b><i>"])
def test_broken_markup_takes_linear_time(unit):
    started = time.time()
    html.main_text(unit * (5_000_000 // len(unit)) + "'")
    assert time.time() - started < 15


def test_tags_end_outside_of_quoted_values():
    page = "<article><p title='a > b' data-x=\"1>2\">One don't.</p><p title=don't>Two it's.</p><p a='>Three.</p></article>"
    assert html.main_text(page) == "One don't.\nTwo it's.\nThree."


CLEAR = ("sidebar", "left-sidebar", "cookie-banner", "notice", "newsletter-signup", "breadcrumbs", "related-posts", "menu", "reader-comments",
         "user-comment", "advertisement-label", "comment-list", "share-buttons")


def test_what_is_set_aside_inside_a_main_part():
    story = "".join(f"<p>{i} " + "words of the story " * 9 + "</p>" for i in range(6))
    kept = html.main_text(f"<main><article>{story}</article></main>")
    assert kept.count("\n") == 5
    for name in CLEAR:
        extra = f"<div class='{name}'><p>" + "outside of the story " * 12 + "</p></div>"
        for page in (f"<article>{story}{extra}</article>", f"<main>{extra}{story}</main>", f"<article>{extra.replace('class', 'id')}{story}</article>"):
            assert html.main_text(page) == kept, name
    for tag, attribute in (("h2", "id='related-work'"), ("h2", "id='search'"), ("section", "id='notice'"), ("div", "class='entry-header'"),
                           ("div", "class='side by side'"), ("section", "aria-label='Search'"), ("h2", "class='menu'")):
        assert html.main_text(f"<article>{story}<{tag} {attribute}>Its own part</{tag}></article>") == f"{kept}\nIts own part"


def test_windows_over_many_empty_lines_take_linear_time():
    text = "\n" * 40_000 + " ".join(map(str, range(60))) + "\n" * 40_000 + "some words\n" * 10_000
    started = time.time()
    found = list(linededup.fingerprints(text))
    assert time.time() - started < 15 and len(found) > 80_000
    values = np.array([5, 3, 9, 1, 7, 7, 2])
    ranges = np.array([(i, j) for i in range(7) for j in range(i, 7)])
    got = linededup.smallest(values, ranges[:, 0], ranges[:, 1])
    assert got.tolist() == [values[i : j + 1].min() for i, j in ranges]
    same = "\n".join(["x", "y z"] * 50)
    digests = {(b - a, d) for _, d, a, b in linededup.fingerprints(same)}
    assert len(digests) == 3  # x to z, y to z, y to x
