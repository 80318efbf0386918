"""HTML extraction beside a plain reader of pages."""

import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest
from opinionmill.llm import html_text, queries
from opinionmill.llm.common import distinct_sample

BLOCKS = {"p", "h1", "h2", "h3", "li", "div", "article", "nav", "ul", "footer", "header", "section", "body", "aside", "form"}


class Article(HTMLParser):
    """Text inside article elements, a line for each block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in BLOCKS:
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data

    def text(self):
        return "\n".join(line for line in (" ".join(x.split()) for x in self.lines) if line)


def test_op6(spark, sf, frame):
    pages = frame("pages").set_index("page_id")
    rows = queries.op6_html(spark, sf).toPandas()
    assert sorted(rows["page_id"]) == sorted(pages.index)
    for row in rows.itertuples():
        assert row.url == pages["url"][row.page_id] and row.n_chars == len(row.text)
        assert row.text == Article(pages["html"][row.page_id]).text()


def test_blocks_of_broken_markup():
    page = (
        "<!DOCTYPE html><title>no</title><body><div>a &amp; b<br>c\n d<p>one <b>two<p>three</div><ul><li>x<li>y <a href='/?a>b'>z</a></ul>"
        "<script>if (a<b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><table><tr><td>1<td>2</table>"
        "<textarea><p>no</textarea>&#233;&eacute;&copy 5 < 6 <p>end"
    )
    assert [b.text for b in html_text.blocks(page)] == ["a & b c d", "one two", "three", "x", "y z", "1", "2", "éé© 5 < 6", "end"]
    assert html_text.blocks("") == [] and html_text.blocks("plain text")[0].text == "plain text"
    assert [b.text for b in html_text.blocks("<p>open <a href=\"x")] == ["open"]
    assert [b.text for b in html_text.blocks("x <script>never closed <p>no")] == ["x"]


def read(page):
    return [b.text for b in html_text.blocks(page)]


def test_omitted_tags_of_head_and_body_lose_no_text():
    assert read("<html><head><title>t</title><p>First paragraph<p>Second") == ["First paragraph", "Second"]
    assert read("<head><meta charset=x><link rel=y><style>a{}</style>Bare text<p>more") == ["Bare text", "more"]
    assert read("<head><noscript><img src=x><p>no</noscript><title>t</title></head><p>yes") == ["yes"]
    assert read("<head><title>never closed<body><p>yes") == ["yes"] == read("<title>never closed<p>yes")
    assert read("<p>one<head><p>two") == ["one", "two"]


def test_hidden_elements_without_an_end_hide_their_own_text_only():
    assert read("<body><article><button>Go<p>Para one</p><p>Para two</p></article>") == ["Para one", "Para two"]
    assert read("<article><button>Go<p>one</p><button>x</button><p>two</article><p>three") == ["one", "two", "three"]
    assert read("<article><svg><g><path d='x'><p>one</article><div>two</div>") == ["one", "two"]
    assert read("<p>a</p><button><div>Go</div></button><p>b</p><select><option>x<option>y</select><p>c") == ["a", "b", "c"]


@pytest.mark.parametrize("element", ["<div>x", "<span><p>x", "<ul><li>x", "<b>x<i>"])
def test_deep_nesting_takes_time_by_the_page(element):
    """50,000 levels: every path is shared with the parent's."""
    net = html_text.new_labeller(3)
    started = time.process_time()
    page = html_text.blocks("<article>" + element * 50_000)
    found = html_text.label(net, [page])[0]
    assert time.process_time() - started < 30 and len(found) == len(page)
    assert "".join(b.text for b in page).count("x") == 50_000


def test_shared_paths_give_the_means_of_written_ones():
    net = html_text.new_labeller(5)
    page = html_text.blocks("top<main><div class='a nav'><p>x<ul><li>y<li>z</ul></div><p>w</main><footer>f")
    for hide in (False, True):
        steps = html_text.steps_of(page, hide)
        assert np.allclose(steps.pooled(net.steps), html_text.pooled(net.steps, steps.rows(slice(None))), atol=1e-6)


def test_repeated_pages_teach_once(spark):
    """One row in most of the table, and null ids, don't fill the sample."""
    rows = [(1, f"<p>same {0}")] * 4_000 + [(None, f"<p>{i}") for i in range(2_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(7)
    drawn = [r.html for r in distinct_sample(pages, "html", 200, seed=3).collect()]
    assert 120 < len(drawn) < 300 and len(set(drawn)) == len(drawn)


def test_marks_teach():
    page = html_text.blocks(
        "<header>h</header><nav>n</nav><article><h1>t</h1><p>text</p><div class='share-bar'>s</div><section class=comments><p>c</p></section>"
        "</article><aside>a</aside><div class='ad'>d</div><div class='cookie-notice'>k</div><form>f</form><footer>z</footer>"
    )
    assert [b.text for b, y in zip(page, html_text.taught(page)) if y] == ["t", "text"]


def test_odd_pages(spark, sf):
    long = "<article>" + "<p>some words of a text that goes on, and on.</p>" * 3_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>"), (3, "u", "<nav>menu</nav>"), (4, "w", long), (4, "w", long)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, _found int")
    net = html_text.fit(queries.table(spark, sf, "pages"))
    found = {(r.page_id, r.url): r for r in html_text.extract(pages, net).collect()}
    assert [found[k].text for k in [(1, "u"), (2, None), (None, "v"), (3, "u")]] == [""] * 4
    assert found[4, "w"].n_chars == 3_000 * 46 - 1 + 0 * len(long) or found[4, "w"].text.count("\n") == 2_999
    assert html_text.extract(pages.limit(0)).count() == 0


def test_gradients_of_the_blocks_network():
    """Backpropagation through time beside differences."""
    rng = np.random.default_rng(3)
    net = html_text.new_labeller(2)
    layer = tuple(w.astype(float) for w in net.forward)
    x, there = rng.normal(size=(4, 3, html_text.INPUTS)), np.arange(4)[:, None] < np.array([4, 2, 3])[None, :]
    pull = rng.normal(size=(4, 3, html_text.STATES)) * there[:, :, None]
    keep: list = []
    html_text.run(layer, x, there, keep)
    grads, g_x = html_text.run_back(layer, x, keep, pull)
    loss = lambda: (html_text.run(layer, x, there).astype(float) * pull).sum()
    for weight, grad in [*zip(layer, grads), (x, g_x)]:
        for i in range(6):
            at = tuple(np.random.default_rng(i).integers(0, s) for s in weight.shape)
            before = weight[at]
            weight[at] = before + 1e-2
            up = loss()
            weight[at] = before - 1e-2
            down = loss()
            weight[at] = before
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_a_very_long_page_is_labelled_alone():
    net = html_text.new_labeller(3)
    cell = html_text.Path(html_text.Path(html_text.Path(), ("ul",)), ("li",))
    pages = [[html_text.Block(f"cell {i}", cell, 0.0) for i in range(n)] for n in [50_000, 0] + [20] * 127]
    tracemalloc.start()
    found = html_text.label(net, pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert [len(f) for f in found] == [len(p) for p in pages]
    assert np.allclose(found[0], html_text.label(net, pages[:1])[0], atol=1e-5) and np.allclose(found[2], found[-1], atol=1e-5)
