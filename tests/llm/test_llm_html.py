import random

import numpy as np
import pytest

from conftest import SF_SMALL
from veritab.llm import html_extraction as H
from veritab.llm.html_blocks import leaf_blocks

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-banner"><p>We use cookies to track you.</p></div>
<article><h1>The tale &amp; more</h1><p>First
 paragraph with <b>bold</b> text &eacute;&#33;<p><b>Unclosed.<br><p>Second paragraph, short.</p>
<div class="advert">Buy now!</div><p>Be.</p></article>
<section id="comments"><div class="comment"><p>I like this a lot, reader says.</p></div></section>
<form action="/x"><label>Email</label><input></form><footer><p>&copy; 2020 site</p></footer></body></html>"""


def test_blocks():
    texts = [b.text for b in leaf_blocks(PAGE)]
    assert texts[4:9] == ["First paragraph with bold text é!", "Unclosed.", "Second paragraph, short.", "Buy now!", "Be."]
    assert "no" not in texts and "T" not in texts
    assert [b.text for b in leaf_blocks("a<b>c</b>d<div>x</div><3 <p>y</nope>z<li>1<li>2<ul><li>3</ul>")] == ["acd", "x", "<3", "yz", "1", "2", "3"]
    for odd in ("", "<", "<p", "</p>", "<script>x", "<!--", "plain", "<p class='a>b' x>t</p>", "<br><br>", "&lt;p&gt;"):
        leaf_blocks(odd)
    assert leaf_blocks("&lt;p&gt;")[0].text == "<p>"


def test_unclosed_and_self_closing_elements_lose_no_text():
    def texts(html):
        return [b.text for b in leaf_blocks(html)]

    assert texts('<p>icon <svg class="i" /> two</p><p>three</p>') == ["icon two", "three"]
    assert texts('<p>a <svg/> b</p><p>c</p><p><svg><title>t</title><svg/><path/></svg>d</p>') == ["a b", "c", "d"]
    assert texts("<p>a<svg><path></p><p>b</p>") == ["a", "b"]
    for tag in ("select", "object", "noscript", "template", "iframe"):
        assert texts(f"<p>a</p><{tag}><p>b</p><p>c</p>") == ["a", "b", "c"], tag
    assert texts("<p>a</p><noscript>b</noscript><object>c</object><p>d</p>") == ["a", "b", "c", "d"]
    assert texts("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == ["so x=2 holds"]
    assert texts("<p>so <math/> holds</p><p>e</p>") == ["so holds", "e"]
    assert texts("<p>a<svg><path></p><p>b</p><svg>x</svg><iframe>y</iframe><p>c</p><template>z</template>") == ["a", "b", "c"]
    assert len(texts("<svg><iframe>x" * 20_000)) == 20_000  # in one pass
    for tag in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a</p><{tag}>b") == ["a"] and texts(f"<p>a</p><{tag}/>b</{tag}><p>c</p>") == ["a", "c"], tag


def test_quotes_open_values_only_behind_an_equals_sign():
    def texts(html):
        return [b.text for b in leaf_blocks(html)]

    assert texts("<p title=it's>First sentence here.</p><p title=that's>Second one.</p>") == ["First sentence here.", "Second one."]
    assert texts("<a title=Bob's>Bob</a> says <p>hello there</p><p>it's done</p><p>more</p>") == [
        "Bob says", "hello there", "it's done", "more"]
    assert texts('<p>a <img alt="5" tall"> b</p><p>"c"</p>') == ["a b", '"c"']
    assert texts("<p class='x>y' id = \"a>b\" data-z = c>t</p><p '>u</p><p \">v</p><p a=\"open>w</p>") == ["t", "u", "v", "w"]
    assert texts("<p a= >x</p><p a=b'c\"d>y</p><p =\"z>\">q</p>") == ["x", "y", "q"]
    assert leaf_blocks('<div title="class=menu" CLASS=big>x</div>')[0].path.names == ("div", ".big")
    assert len(texts("<p " + "a=b " * 50_000)) == 1 and texts("<p " + 'a="b ' * 20_001 + ">x") == ["x"]


def test_deep_pages_take_linear_time():
    import time
    start = time.perf_counter()
    for html in ("<div>word" * 100_000, "<li><b>word" * 50_000, "<div class=x>w</b>" * 60_000, "<b><div>w</b>" * 60_000, "<td>w<a>" * 50_000):
        assert len(leaf_blocks(html)) >= 50_000
    assert time.perf_counter() - start < 12


def test_gradients():
    blocks = leaf_blocks(PAGE)
    model = H.BlockLabeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages, labels = [blocks, blocks[:3]], [[k % 2 for k in range(len(blocks))], [1, 0, 1]]

    def loss():
        x, mask, at, _ = model.inputs(pages)
        z = model.logits(x.astype(np.float64), mask.astype(np.float64))[at[:, 0], at[:, 1]]
        y = np.concatenate(labels)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    grads = model.gradients(pages, labels)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in g.shape) if name not in ("path", "word") else np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        up = loss()
        model.p[name][at] = old - 1e-3
        down = loss()
        model.p[name][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


@pytest.fixture(scope="module")
def labeller(spark):
    return H.fit_labeller(spark.read.parquet(SF_SMALL.replace("0.001", "0.01") + "/pages.parquet"))


def test_other_pages_and_layouts(spark, labeller):
    pages = [r["html"] for r in spark.read.parquet(SF_SMALL.replace("0.001", "0.1") + "/pages.parquet").limit(400).collect()]
    blocks = [leaf_blocks(h) for h in pages]
    truth = [H.teacher_labels(b) for b in blocks]
    wrong = sum(int(a) != b for x, y in zip(labeller.labels(blocks), truth) for a, b in zip(x, y))
    assert wrong <= 3
    made = H.page_variants([(b, y) for b, y in zip(blocks, truth) if any(y)][:150], 1, random.Random(77))
    found = labeller.labels([b for b, _ in made])
    wrong = sum(int(a) != b for x, (_, y) in zip(found, made) for a, b in zip(x, y))
    assert wrong < 0.01 * sum(len(y) for _, y in made)
    own = leaf_blocks(PAGE)
    assert [b.text for b, keep in zip(own, labeller.labels([own])[0]) if keep] == [
        "The tale & more", "First paragraph with bold text é!", "Unclosed.", "Second paragraph, short.", "Be."]


def test_query_and_awkward_rows(spark):
    pages = spark.read.parquet(SF_SMALL + "/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<script>x</script>"), (3, "v", "<")],
                                "page_id long, url string, html string")
    out = H.extract_text(pages.unionByName(odd).selectExpr("*", "1 as text", "2 as path"), limit=40).collect()
    assert len(out) == pages.count() + 5
    texts = {r["page_id"]: r for r in pages.collect()}
    bad = 0
    for r in out:
        assert r["n_chars"] == len(r["text"])
        if r["url"] and r["page_id"] in texts and texts[r["page_id"]]["url"] == r["url"]:
            blocks = leaf_blocks(texts[r["page_id"]]["html"])
            bad += r["text"] != "\n".join(b.text for b, y in zip(blocks, H.teacher_labels(blocks)) if y)
    assert bad <= 2
    assert H.extract_text(pages.limit(0)).count() == 0


def test_samples_without_landmarks(spark):
    long = "A sentence that is long enough to be taken for the prose of an article, as it goes on and on. "
    pages = spark.createDataFrame([(i, "u", f"<div><a href=x>Menu</a></div><div>{long * 2} {i}</div><div><a>Imprint</a></div>") for i in range(30)],
                                  "page_id long, url string, html string")
    assert {r["text"] for r in H.extract_text(pages).collect()} == {" ".join(f"{long * 2} {i}".split()) for i in range(30)}
    short = spark.createDataFrame([(1, "u", "<p>Menu</p><p>b</p>")], "page_id long, url string, html string")
    assert H.extract_text(short).first()["text"] == "Menu\nb"
