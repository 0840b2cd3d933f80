import html
import itertools
import re

import numpy as np
import pytest

from punctual.llm import extraction as E
from punctual.llm.blocks import leaf_blocks
from punctual.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain  text\n only", ["plain text only"]),
        ("<p>a<b>b</b> c<br>d<p>e</p>f", ["ab c d", "e", "f"]),
        ("<p>x &amp; y&nbsp;&eacute;&#x41;</p>", ["x & y éA"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>a</p><!-- <p>no</p> --><noscript><p>n</p></noscript>", ["a"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<p title='a>b' data-x=\"<p>\">t</p>", ["t"]),
        ("<p title='never closed>t</p><p>u", ["t", "u"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<head><title>T</title></head><body>b", ["b"]),
        ("<head><title>T</title><body>b", ["b"]),
        ("a < b and <3 c", ["a < b and <3 c"]),
        ("</p></div>x<script>cut off", ["x"]),
        ("<div>" * 3000 + "deep", ["deep"]),
    ],
)
def test_leaf_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<head><title>T</title><p>text", ["text"]),
        ("<!doctype html><head>\n<meta charset=utf-8><script>s</script><noframes>n</noframes>\n<div>a</div><p>b", ["a", "b"]),
        ("<head><title>T</title>text<p>b", ["text", "b"]),
        ("<header><p>a</header><p>b", ["a", "b"]),
        ("<p>a<svg viewBox='0 0 1 1'/>b<p>c<math/><p>d<svg><text>no</text></svg>", ["a b", "c", "d"]),
        ("<svg><svg/><text>no</text></svg><p>a", ["a"]),
        ("<object><object>no</object>no</object><p>a", ["a"]),
        ("<svg><!-- <svg> --><style>/* <svg> */</style><text>no</text></svg><p>a", ["a"]),
        ("<p>a<object data=x><p>b<canvas><p>c<noscript><p>d", ["a", "b", "c", "d"]),
        ("<p>a<canvas><p>b<canvas>no</canvas><p>c", ["a", "b", "c"]),
        ("<p>a<title>b", ["a b"]),
        ("<p>a<style>cut off", ["a"]),
        ("<object>" * 20_000 + "<noscript>" * 20_000 + "a", ["a"]),
    ],
)
def test_silent_elements_drop_nothing_else(page, want):
    assert texts(page) == want


def test_viterbi_equals_all_labelings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        for _ in range(10):
            scores, moves = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
            value = lambda y: sum(s * a for s, a in zip(scores, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
            best = max(itertools.product((0, 1), repeat=n), key=value)
            assert value(E.viterbi(scores.tolist(), moves)) == pytest.approx(value(best))
    assert E.viterbi([], np.zeros((2, 2))) == []


def test_fit_is_a_maximum_of_the_likelihood(monkeypatch):
    """Against the likelihood by all labelings of short sequences."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(E, "STEPS", 600)
    sequences = [[sorted(rng.choice(E.N_FEATURES, 2, replace=False).tolist() + [0] * int(rng.random() < 0.5)) for _ in range(rng.integers(1, 5))] for _ in range(25)]
    sequences = [[sorted(set(f)) for f in s] for s in sequences]
    labels = [[int(0 in f) if rng.random() < 0.8 else int(rng.random() < 0.5) for f in s] for s in sequences]
    total = sum(map(len, sequences))

    def objective(weights, moves):
        out = 0.0
        for s, y in zip(sequences, labels):
            unary = [weights[f].sum() for f in s]
            value = lambda z: sum(u * a for u, a in zip(unary, z)) + sum(moves[a, b] for a, b in zip(z, z[1:]))
            out += value(y) - np.logaddexp.reduce([value(z) for z in itertools.product((0, 1), repeat=len(s))])
        return -out / total + E.RIDGE / 20 * ((weights**2).sum() + (moves**2).sum())

    field = E.fit(sequences, labels)
    best = objective(field.weights, field.moves)
    assert best < objective(np.zeros(E.N_FEATURES), np.zeros((2, 2)))
    for _ in range(20):
        moved = objective(field.weights + rng.normal(0, 0.05, E.N_FEATURES), field.moves + rng.normal(0, 0.05, (2, 2)))
        assert moved > best - 1e-4


@pytest.fixture(scope="module")
def field(spark):
    return E.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def article(page):
    """The article's text by the markup that the given pages have."""
    inner = re.search(r"<article>(.*?)(</article>|(?=<footer)|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|article)>", inner)
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks) if x)


def test_query_finds_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries()["op3_crf_main_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    assert np.mean([r.text == article(pages[r.page_id].html) for r in rows]) > 0.99


def test_variants_of_unseen_pages(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(80).collect()
    wrong = total = 0
    for r in pages:
        for found, labels in E.variants(r.html, r.page_id + 10_000):
            weights = field.weights
            got = E.viterbi([weights[f].sum() for f in E.block_features(found)], field.moves)
            wrong += sum(a != b for a, b in zip(got, labels))
            total += len(labels)
    assert wrong < 0.01 * total


PAGE = """<html><body><header><h1>Site</h1><p>Tagline of the site</p></header><nav><a href='/'>Home</a></nav>
<main><h1>The title of the story</h1><p>First paragraph with enough words to read like prose, and an end.</p>
<aside><p>Subscribe to our newsletter today.</p></aside><p>Second paragraph goes on with the story, as one would expect.</p></main>
<section id="comments"><div class="comment"><p>I do not agree with any of this at all, dear author.</p></div></section>
<div class="cookie-notice"><p>We use cookies on this site.</p></div><form><label>Email</label><button>Go</button></form>
<footer><p>Copyright 2024</p></footer></body></html>"""


def test_parts_around_the_article_go(field):
    assert E.main_blocks(PAGE, field) == [
        "The title of the story",
        "First paragraph with enough words to read like prose, and an end.",
        "Second paragraph goes on with the story, as one would expect.",
    ]


def test_odd_pages(spark, field):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (None, "u", PAGE), (5, "u", PAGE), (5, "u", PAGE), (6, "u", "<article>" + "<p>a b c.</p>" * 20_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = E.extract(frame, field).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert len({r.text for r in got if r.page_id in (5, None)}) == 1
    assert next(r for r in got if r.page_id == 6).text == "\n\n".join(["a b c."] * 20_000)
    assert E.extract(frame.limit(0), field).count() == 0
    rule = E.train(frame.where("page_id < 5"))
    assert np.array_equal(rule.weights, E.rule_field().weights)
    assert "Second paragraph" in "".join(E.main_blocks(PAGE, rule)) and "Tagline" not in "".join(E.main_blocks(PAGE, rule))
