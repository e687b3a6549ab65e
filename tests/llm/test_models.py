"""The classifier and the page extractor: held-out accuracy, known pages, odd rows."""

import html
import re
import zlib

import numpy as np

from drawbook.llm import maintext, quality


def test_classifier(spark):
    random = np.random.default_rng(6)
    vocabulary = ["".join(random.choice(list("abdeghilnorst"), random.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(vocabulary[k] for k in random.integers(0, 400, n))
    rows = []
    for k in range(600):
        good = random.random() < 0.8
        n = int(random.integers(15, 90))
        text = prose(n) if good else (prose(3) + " ") * (n // 3) if random.random() < 0.5 else " ".join(w + "%$" for w in prose(n).split())
        rows.append((k, text, int(good), "clash"))
    odd = [(1000, None, 1, ""), (1001, "", 0, ""), (None, rows[0][1], 1, ""), (0, rows[0][1], rows[0][2], "")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, y int, score string").drop("y").repartition(4)
    labels = spark.createDataFrame([*((k, y) for k, _, y, _ in rows), (5, 1 - rows[5][2]), (7, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert out.count() == len(rows) + len(odd) and all(0 <= s <= 1 for s in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.7) == bool(y) for k, _, y, _ in held]) > 0.95
    assert got[1000] == got[1001] > 0.7
    # What a score says depends on the text alone, and the held-out rows' labels are never learnt.
    assert got[None] == got[0]
    turned = quality.fit(docs, spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, _, y, _ in rows], "doc_id long, quality int"))
    same = quality.fit(docs, spark.createDataFrame([(k, y) for k, _, y, _ in rows], "doc_id long, quality int"))
    assert np.array_equal(turned.weights(), same.weights())
    by_text = {t: quality.chunk_scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), model.weights(), model.intercept())[0] for _, t, _, _ in rows[:20]}
    assert all(abs(by_text[t] - got[k]) < 1e-6 for k, t, _, _ in rows[:20])
    own = quality.train([t for _, t, _, _ in rows[:60]], np.array([y for _, _, y, _ in rows[:60]]), 0.8, least_steps=200)
    for t in list(by_text)[:5]:  # the folded weights are the softmax of the averaged vectors
        features, share = quality.document_features(t)
        z = share @ own.vectors[features] @ own.output + own.bias
        folded = quality.chunk_scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), own.weights(), own.intercept())[0]
        assert abs(np.exp(z[1]) / np.exp(z).sum() - folded) < 1e-3


def test_classifier_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 0
    assert [r["score"] for r in quality.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).collect()] == [0.5]
    one = quality.fit(spark.createDataFrame([(1, "x y z")], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert 0 <= one.intercept()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) document.write("</p>")</script></head><body class=x>
<!-- <p>not here</p> --><header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href="/a">One</a></li><li><a href='/b>'>Two</a></li></ul></nav>
<div class="cookie-banner">We use cookies. Please accept them all.</div><{tag} class="{name}"><h1>The&nbsp;title &amp; more</h1><p>First <b>para</b>graph of the
 story, with &lt;tags&gt; and <i>some</i> words in it.<p>Second one<br>goes on for a while and ends. It has a second sentence.</p>
<div class="ad">Buy this thing now.</div><ul><li>An item of the list in the story.</li></ul></{tag}>
<aside class="sidebar"><h3>Related posts</h3><ul><li><a href=/r>Another story</a></li></ul></aside>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story very much. It was good to read.</p></div></section>
<form action="/s"><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; 2024 Site name. All rights reserved.</footer></body></html>"""
TEXT = "The title & more First paragraph of the story, with <tags> and some words in it. Second one goes on for a while and ends. It has a second sentence. An item of the list in the story."


def plain_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", inner))).strip()


def test_leaf_blocks():
    blocks = maintext.leaf_blocks(PAGE.replace("{tag}", "article").replace("{name}", ""))
    assert [b.text for b in blocks if any(t == "article" for t, _ in b.path)] == [
        "The title & more", "First paragraph of the story, with <tags> and some words in it.", "Second one goes on for a while and ends. It has a second sentence.",
        "Buy this thing now.", "An item of the list in the story."]
    assert not any("not here" in b.text or "document" in b.text or b.text == "T" for b in blocks)
    assert [b.linked for b in blocks if b.text == "Two"] == [1.0]
    for odd in ("", "<", "<p", "<p class='", "text only", "</p></div>", "<script>never closed", "<!-- open", "a < b & c &amp d", "<b><i>x</b>y</i>", "<p>" * 3000 + "deep"):
        maintext.leaf_blocks(odd)
    assert [b.text for b in maintext.leaf_blocks("a < b &amp; c")] == ["a < b & c"]


def test_field_against_all_labelings():
    import itertools

    random = np.random.default_rng(1)
    blocks = maintext.leaf_blocks(PAGE.replace("{tag}", "article").replace("{name}", ""))[:9]
    for _ in range(10):
        names = {f for k, b in enumerate(blocks) for f in (*maintext.path_features(b.path), *maintext.text_features(b, k, len(blocks)))}
        model = maintext.FieldModel({f: float(random.normal()) for f in names}, random.normal(size=(2, 2)), random.normal(size=2))
        score = model.scores(blocks)
        value = lambda y: model.start[y[0]] + sum(model.moves[a, b] for a, b in itertools.pairwise(y)) + sum(s for s, x in zip(score, y, strict=True) if x)  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert tuple(model.decode(blocks)) == best


def test_extraction(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = maintext.fit_field(pages)
    for tag, name in (("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content")):
        blocks = maintext.leaf_blocks(PAGE.replace("{tag}", tag).replace("{name}", name))
        assert " ".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y) == TEXT, (tag, name)
    rows = [(r["page_id"], r["url"], r["html"], "old") for r in pages.collect()]
    odd = [(None, None, None, None), (5, "u", "", ""), (6, "u", "<p>", ""), (rows[0][0], rows[0][1], rows[0][2], "")]
    out = maintext.extract_text(spark.createDataFrame([*rows, *odd], "page_id long, url string, html string, text string").repartition(3), model)
    assert out.columns == ["page_id", "url", "text", "n_blocks"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    want = {r[0]: plain_article(r[2]) for r in rows}
    wrong = [r for r in got if r["url"] not in (None, "u") and r["text"] != want[r["page_id"]]]
    assert not wrong
    assert [r["text"] for r in got if r["url"] in (None, "u")] == ["", "", ""]
    assert maintext.extract_text(pages.limit(0), maintext.fit_field(pages.limit(0))).count() == 0


def test_no_text_is_dropped_before_the_field():
    texts = lambda page: [b.text for b in maintext.leaf_blocks(page)]
    assert texts("<html><head><title>T</title><meta charset=x><body><p>One.</p>") == ["One."]
    assert texts("<head><title>T <b> x</title><link rel=x><style>p{}</style><p>One.</p>") == ["One."]
    assert texts("<head><title>T</title>Bare text<p>One.") == ["Bare text", "One."]
    assert texts("<head><noscript><link rel=x></noscript><title>T</title></head><body><p>One.") == ["One."]
    for tag in ("object", "svg", "math", "canvas", "audio", "video", "template", "noscript", "iframe"):
        assert "The rest." in texts(f"<p>One.</p><{tag}><p>Two.</p><div>The rest.</div>"), tag
    for tag in ("title", "textarea", "select", "datalist"):
        assert "The rest." in texts(f"<p>One.</p><{tag}><option>x</option><div>The rest.</div>"), tag
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><noscript><p>Plain.</p></noscript><object>Old.</object></article>") == ["Let x=2 hold.", "Plain.", "Old."]
    assert texts("<p>One.</p><script>var a = '<p>';</script><style>p{}</style><select><option>No</option></select><p>Two.</p>") == ["One.", "Two."]
