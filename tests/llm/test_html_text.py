import html
import itertools
import math
import random
import re
import time

import pytest

from tidefold.llm.html_text import Model, Node, extract, features, main_text, marginals, message

SCHEMA = "page_id long, url string, html string, text string"


def article_text(page):
    """The paragraphs and headline of the only article, for the synthetic pages."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, article_text(r.html)) for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_marginals_equal_enumeration():
    rng = random.Random(3)
    for _ in range(30):
        nodes = [Node("div", None)]
        for _ in range(7):
            nodes.append(Node(rng.choice(["p", "h1", "b2"]), rng.choice(nodes)))
        model = Model({f"tag {t}": rng.uniform(-3, 3) for t in ("p", "h1", "b2")}, rng.uniform(0.3, 2))
        own = [sum(model.weights.get(f, 0) for f in features(n)) for n in nodes]
        edges = [(k, next(i for i, m in enumerate(nodes) if m is n.parent)) for k, n in enumerate(nodes) if n.parent]
        total = [[0.0, 0.0] for _ in nodes]
        for states in itertools.product((0, 1), repeat=len(nodes)):
            energy = sum(o for o, s in zip(own, states) if s)
            energy += sum(model.same if states[a] == states[b] else -model.same for a, b in edges)
            for k, s in enumerate(states):
                total[k][s] += math.exp(energy)
        for got, (no, yes) in zip(marginals(nodes, model), total):
            assert abs(got - math.log(yes / no)) < 1e-9
    assert abs(message(500.0, 1.0) - 2.0) < 1e-9 and abs(message(-500.0, 1.0) + 2.0) < 1e-9


def test_other_layouts_and_broken_markup(spark):
    rows = [(i, r.url, r.html, "x") for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(100).collect())]
    more = {
        1000: (
            '<body class="has-sidebar"><div class="cookie-banner">We use cookies.</div><header><a href=/>Site</a></header><main><h1>Title &amp; more</h1>'
            "<p>First long paragraph, with <a href=x>a link</a> and text; it goes on.<p>Second<br>paragraph\n is  here, too.<aside>Related, buy now.</aside>"
            "<form>Name, please <input></form></main><section id=comments><article class=comment><p>Great post, thanks, really!</p></article></section>"
            "<footer>&copy; 2020, all of it.</footer>",
            "Title & more\nFirst long paragraph, with a link and text; it goes on.\nSecond paragraph is here, too.",
        ),
        1001: ("just text, no tags", "just text, no tags"),
        1002: ("<p>unclosed <b>bold <i>x</p><p>y</b> z", "unclosed bold x\ny z"),
        1003: ("<!-- open comment <p>x", ""),
        1004: ("<script>var a='<p>text, and more text, and more.'", ""),
        1005: ("<title>t</title><article><p>x &lt;b&gt; &#x41;&nbsp;y&amp</article>", "x <b> A y&"),
        1006: ("", ""),
        1007: (None, ""),
        1008: ("<article><p>" + "long text, words. " * 40_000 + "</p></article>", ("long text, words. " * 40_000).strip()),
        1009: ("<div>" * 3000 + "<article><p>deep, deep text</p></article>", "deep, deep text"),
        1010: ("<p>a < b and c > d, e<3</p></article></nav>", "a < b and c > d, e<3"),
    }
    rows += [(k, None, page, None) for k, (page, _) in more.items()] + [(1002, None, more[1002][0], None)]
    got = [(r.page_id, r.text) for r in extract(spark.createDataFrame(rows, SCHEMA)).where("page_id >= 1000").collect()]
    assert sorted(got) == sorted([(k, t) for k, (_, t) in more.items()] + [(1002, more[1002][1])])


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a href='" * 110_000, '<p title="x' * 90_000, "<div>" * 60_000 + "</p>" * 60_000, "<p><b class=ad>" + "<i class=ad>" * 40_000 + "</b><u>" * 40_000,
    "<div><span class=ad>" * 30_000 + "</span>" * 30_000, "<!--" * 250_000, "<x>" * 80_000 + "<p>" * 80_000, "<script" * 140_000, "</script <" * 100_000, "=\"='" * 250_000,
], ids=range(11))
def test_a_megabyte_of_broken_markup_takes_seconds(page):
    began = time.process_time()
    main_text(page, Model({}, 1.0))
    assert time.process_time() - began < 15  # quadratic ways take hours


def test_empty(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []
    assert main_text("<p></p>", Model({}, 1.0)) == ""
