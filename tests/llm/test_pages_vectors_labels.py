"""HTML extraction, embedding near-duplicates and toxicity on small cases."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varscope.llm import embedding_index, html_mincut, toxicity

PAGE = """<!DOCTYPE html><html><head><title>Title of the site</title><style>p{margin:0}</style></head>
<body class="has-sidebar"><header><h1>Site name</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies on this site to make it better for you. OK?</p></div><!-- <p>hidden</p> -->
<article><header><h2>The real &amp; only title</h2></header><p>First <b>para</b>graph of the article, with a fair number of words&nbsp;in it.
<p>Second one, &lt;unclosed&gt; like the first&hellip; and <a href="x">a link</a> in it.
<div class="ad-box"><p>Buy our great product today, it is cheap.</p></div><ul><li>item one</li><li>item two</li></ul>
<script>var x = "<p>not text</p>";</script><blockquote>Quoted words end the article here.</blockquote><footer>Filed under news</footer></article>
<aside><p>Another story that you may like, with quite some text of its own.</p></aside>
<section id="comments"><h3>Comments</h3><article class="comment"><p>I think that this is a very good article, thank you for it.</p></article></section>
<form><label>Name</label><textarea>typed</textarea></form><footer>&copy; 2024 Site, all rights reserved.</footer>"""
TEXT = ("The real & only title First paragraph of the article, with a fair number of words in it. Second one, <unclosed> like the "
        "first… and a link in it. item one item two Quoted words end the article here.")
PLAIN = """<body><div class=top><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><div><h1>A plain page</h1>
<div>It has no article element but long paragraphs of plain text, one after the other, that tell a story.</div>
<div>The second paragraph goes on with the story, and it is as long as the first one was, more or less.</div><div>Short.</div>
<div>The last paragraph ends the story with a few more words so that the reader may go home.</div></div>
<div><a href=4>Next</a> <a href=5>Previous</a></div></body>"""


def test_extract():
    assert html_mincut.extract(PAGE)[0] == TEXT
    text = html_mincut.extract(PLAIN)[0]
    assert text.startswith("A plain page It has no article") and "Short." in text and text.endswith("go home.")
    for odd in (None, "", " ", "<", "<a", "<p", "<!--", "<script>", "</p></div>", "<p>" * 3000, "<div class='x" * 50, "&#xD800;&#0;&bogus;"):
        html_mincut.extract(odd)
    assert html_mincut.extract("<article><p>a&#65;&amp;lt; b</p></article>")[0] == "aA&lt; b"


@pytest.mark.parametrize("tag", [
    '<svg class="icon" viewBox="0 0 1 1"/>', "<math/>", "<video src=a.mp4>", "<object data=x>", "<canvas id=c>", "<select name=s>",
    "<button>", "<iframe src=y>", "<template>", "<noscript>", "<video-js id=v></video-js>", "<button-group></button-group>",
    "<select-box></select-box>", "<object-view></object-view>", "<title-card></title-card>", "<svg><path/></svg>"])
@pytest.mark.parametrize("later", ["", "<video src=b.mp4>no video</video><button>Send</button>"])
def test_opaque_element_keeps_the_rest(tag, later):
    first, rest = "The first paragraph of the article has a fair number of words.", "The last one has about as many words as it."
    if tag == "<video src=a.mp4>" and later:
        return                                              # then it has an end tag, and holds what is before it
    page = f"<article><p>{first}</p>{tag}<p>{rest}</p>{later}</article>"
    assert html_mincut.extract(page)[0] == f"{first} {rest}"


@pytest.mark.parametrize("attrs", [
    'class="entry-content no-sidebar"', 'class="post-content has-share"', 'class="has-sidebar"', 'class="content with-related-posts"',
    'class="story hasComments"', 'class="post-content layout--without-sidebar"', 'class="entry-content share"',
    'id="content" class="post sidebar-right"'])
@pytest.mark.parametrize("outer", ["<article>%s</article>", "<main class=no-comments>%s</main>", "<article class='post has-related'>%s</article>"])
def test_layout_words_do_not_drop_the_article(attrs, outer):
    first = "The first paragraph of the article has a fair number of words, as paragraphs do."
    rest = "The last one has about as many words as it, and ends the article here."
    aside = "<div class='sidebar no-content'><p>Another story that you may like, with some text of its own.</p></div>"
    page = outer % f"<div {attrs}><p>{first}</p><p>{rest}</p></div>" + aside
    assert html_mincut.extract(page)[0] == f"{first} {rest}"


@pytest.mark.parametrize("attrs", [
    'class="post-comments"', 'class="content-sidebar widget"', 'class="comment-body"', 'id="related" class="story-teaser"',
    'class="share no-sidebar"', 'class="entry comment"', 'id="footer" class="main share"'])
def test_bad_names_stay_boilerplate(attrs):
    page = f"<article><p>The only paragraph of the article has a fair number of words.</p></article><div {attrs}><p>Short text beside it.</p></div>"
    assert html_mincut.extract(page)[0] == "The only paragraph of the article has a fair number of words."


def test_raw_text_without_end_holds_the_rest():
    for tag in html_mincut.RAW_TEXT:
        assert html_mincut.extract(f"<article><p>All the text that is kept.</p><{tag}><p>Not a paragraph of the page.</p>")[0] \
            == "All the text that is kept."
    many = "<article>" + "<svg><button>" * 20_000 + "<p>One line of text.</p></article>"
    assert html_mincut.extract(many)[0] == "One line of text."


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[a][b] = edges[b][a] = rng.uniform(0, 2)

        def cost(label):
            return (sum(-s if s < 0 else 0 for s, x in zip(scores, label) if x) + sum(s if s > 0 else 0 for s, x in zip(scores, label) if not x)
                    + sum(w for a in range(n) for b, w in edges[a].items() if a < b and label[a] != label[b]))

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_mincut.minimum_cut(scores, edges)) == pytest.approx(best)


def test_extract_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>One more line.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = {(r["page_id"], r["url"]): r for r in html_mincut.extract_pages(pages).collect()}
    assert got[1, "u"]["text"] == TEXT and got[1, "u"]["n_chars"] == len(TEXT)
    assert got[2, None]["text"] == got[None, "v"]["text"] == "" and got[2, None]["n_chars"] == 0
    assert got[3, "w"]["text"] == " ".join(["One more line."] * 3000)
    assert html_mincut.extract_pages(pages).count() == 5
    assert html_mincut.extract_pages(pages.limit(0)).count() == 0


def _vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    out = [base]
    for k in range(40):                                     # near copies around the threshold
        step = rng.normal(size=16) * rng.uniform(0.01, 0.35)
        out.append((base[k % 12] + step * np.linalg.norm(base[k % 12]) / 4)[None])
    x = np.concatenate(out).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, [3 * v for v in rows[6][1]]), (5, rows[5][1]), (None, rows[7][1])]
    return rows + [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16),
                   (2004, [float("inf")] + [0.0] * 15), (2005, []), (2006, [1.0, 2.0])]


def test_embedding_near_duplicates(spark):
    rows = _vectors()
    low = -(1 << 62)
    ok = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    x = np.array([np.float32(rows[k][1]) for k in ok], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    n = [0] * len(rows)
    label = [low if i is None else i for i, _ in rows]
    for k, s in zip(ok, hit.sum(axis=1)):
        n[k] = int(s)
    while True:
        new = list(label)
        for a, k in enumerate(ok):
            new[k] = min([label[k], *(label[ok[b]] for b in np.flatnonzero(hit[a]))])
        if new == label:
            break
        label = new
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).repartition(4)
    out = embedding_index.near_duplicates(df, recall=1.0)
    want = [(i, n[k], None if label[k] == low else label[k], (low if i is None else i) == label[k]) for k, (i, _) in enumerate(rows)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    empty = embedding_index.near_duplicates(df.limit(0))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    nothing = embedding_index.near_duplicates(df.filter("vec_id >= 2000")).collect()
    assert len(nothing) == 7 and all(r["kept"] and r["n_links"] == 0 for r in nothing)


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    rows = []
    for width, n in ((16, 700), (8, 400), (6, 3), (2, 2), (1, 1)):      # with an index, with another, without
        base = rng.normal(size=(n, width))
        rows += [(len(rows) + k, [float(v) for v in x]) for k, x in enumerate(base)]
        rows += [(len(rows) + k, [float(v) for v in base[k % n] * 2 + rng.normal(size=width) * 0.01]) for k in range(60 if n > 3 else 1)]
    rows += [(9000 + k, rows[k][1]) for k in (2, 765, 1225)]
    ids = np.array([i for i, _ in rows])
    linked = np.zeros((len(rows), len(rows)), bool)
    for width in {len(v) for _, v in rows}:
        at = np.array([k for k, (_, v) in enumerate(rows) if len(v) == width])
        x = np.array([np.float32(rows[k][1]) for k in at], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        linked[np.ix_(at, at)] = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[k], *label[linked[k]]]) for k in range(len(rows))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(r) for r in embedding_index.near_duplicates(df, recall=1.0).collect())
    assert got == sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(axis=1), label))
    rare = [g for g, (_, v) in zip(got, sorted(rows)) if len(v) != 16]
    assert sum(n > 0 for _, n, _, _ in rare) > 100
    few = embedding_index.near_duplicates(df.filter("size(embedding) = 6")).collect()
    assert sorted(r["n_links"] for r in few)[-2:] == [1, 1]


def test_multi_index_recall_and_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_index.MultiIndex(x, 0.95, 8, recall=0.97)
    row, cell = index.visited(x[:50])
    cost = index.costs(x[:50])
    for r in range(50):
        nearest = np.sort(cost[r])[:index.visits]
        assert np.allclose(np.sort(cost[r][cell[row == r]]), nearest)
    step = rng.normal(size=x.shape)
    step -= (step * x).sum(axis=1, keepdims=True) * x
    other = 0.95 * x + math.sqrt(1 - 0.95 ** 2) * step / np.linalg.norm(step, axis=1)[:, None]
    row, cell = index.visited(x)
    found = np.zeros(len(x), bool)
    found[row[cell == index.cells(other)[row]]] = True
    assert found.mean() >= 0.93


def _labelled(n, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    out = []
    for i in range(n):
        w = rng.choices(pool, k=rng.randint(20, 200))
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(max(2, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(["vilewordy", "nastything", "grimslur"]) + rng.choice(["", "s", "ing"])
        out.append((i, " ".join(w), y))
    return out


def test_toxicity(spark):
    rows = _labelled(900, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "some text"), (5002, "x" * 200_000)],
                                 "doc_id long, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    held = [(out[i]["score"], y) for i, _, y in rows if out[i]["held_out"]]
    assert 0.15 < len(held) / len(rows) < 0.35
    pos, neg = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos]) > 0.97
    assert out[5000]["score"] == out[5001]["score"] < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0
    bare = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert {r["score"] for r in bare.collect()} == {0.0}


def test_attributes_are_read_one_by_one():
    words = "<p>" + "This is a long article paragraph, with many words and some sense in it. " * 6 + "</p>"
    wraps = ['<p title="hidden gems">x</p>%s', '<div title="The hidden city">%s</div>', '<div aria-hidden="false">%s</div>',
             '<div data-x="overflow hidden">%s</div>', '<div data-id="comments-12">%s</div>']
    for w in wraps:
        text = html_mincut.extract("<body><nav><a href=x>Home</a></nav><article>" + w % (words * 3) + "</article></body>")[0]
        assert text.count("long article") == 18, w
    hidden = html_mincut.extract(f"<body><article>{words * 3}<div hidden>{words.replace('long', 'short')}</div></article></body>")[0]
    assert "short article" not in hidden and hidden.count("long article") == 18


def test_broken_pages_take_linear_time():
    import time
    began = time.process_time()
    for page in ('<a "' * 100_000, '<a "' * 100_000 + ">", "<p>x</p><!-- x " + "<b>" * 100_000, "<" * 100_000):
        html_mincut.extract(page)
    assert time.process_time() - began < 5
    assert html_mincut.extract("<p>one two</p><!-- never > ended")[0] == html_mincut.extract("<p>one two</p>")[0]


def test_norms_neither_overflow_nor_vanish(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [2e200, 2e200]), (4, [1e-170, 0.0]), (5, [2e-170, 0.0]), (6, [0.0, 0.0]),
            (7, [1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_index.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}
