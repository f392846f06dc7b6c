"""Top-k search, chat repair and HTML extraction against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookflow.llm import chat, html_extract, topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k, every, scale=256, single=np.float32):
    """Each query row against every other row."""
    sound = [(i, [int(np.floor(scale * float(single(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, (query_id, x) in enumerate(sound):
        if query_id % every == 0:
            best = sorted((-dot(x, y), i) for n, (i, y) in enumerate(sound) if n != q)[:k]
            out += [(query_id, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def results(found):
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("group,block,slab", [(4096, 256, 1024), (20, 4, 3)])
def test_topk(spark, monkeypatch, group, block, slab):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLAB", slab)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # one very common vector
    rows += [(300, None), (310, [NAN, 1.0]), (320, [INF, 0.0]), (330, [None, 1.0]), (None, [1.0] * 6), (340, [5.0, 1.0]), (350, [])]
    rows += [(5, rows[5][1]), (7, [3.0] * 6), (7, [4.0] * 6), (10, rows[10][1]), (20, [2.0] * 6)]  # repeated ids
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, label int")
    assert results(topk.search(vectors, 3, 10)) == brute(rows, 3, 10)


@pytest.mark.parametrize("size", [1e8, 3e6, 1e11])
def test_topk_of_large_components_is_exact(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.round(x)) for x in rng.uniform(-size, size, 4)]) for i in range(60)]
    rows += [(60, [1e8 + 1, 1.0]), (61, [1e8 + 3, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, n, i, max(-(2**63) + 1, min(2**63 - 1, s))) for q, n, i, s in brute(rows, 3, 10, 1, float)]
    if size < 1e9:
        assert results(topk.search(vectors, 3, 10, 1)) == want
    else:  # beyond 64 bits scores are the nearest 64-bit integer
        assert [(q, n, s) for q, n, _, s in results(topk.search(vectors, 3, 10, 1))] == [(q, n, s) for q, n, _, s in want]


def test_only_groups_within_reach_get_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 32)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 40
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=8)]) for i in range(1000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    kept = topk.sent_to_groups

    def spied(packed, width, groups):
        found = kept(packed, width, groups)
        sent.append((found.count(), groups))
        return found

    monkeypatch.setattr(topk, "sent_to_groups", spied)
    assert results(topk.search(vectors, 2, 500)) == brute(rows, 2, 500, single=float)
    assert sent[0][0] < sent[0][1] * 2 / 2


def test_topk_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = topk.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 131072)]


def cheapest(roles):
    """All labellings of a short conversation; the least cost."""
    best = None
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        state, cost = 0, 0
        for role, label in zip(roles, labels):
            if (state, label) not in chat.STEPS:
                break
            cost += chat.STEPS[state, label][0] + chat.label_cost(chat.named(role), label)
            state = label
        else:
            cost += chat.END[state]
            best = cost if best is None else min(best, cost)
    return best


ROLE = st.sampled_from(["system", "user", "assistant", "Human", "bot", None, "tool", ""])


@settings(max_examples=150, deadline=None)
@given(st.lists(ROLE, min_size=1, max_size=6))
def test_repair_is_cheapest_and_legal(roles):
    known = [chat.named(r) for r in roles]
    path = chat.labels(known, 0, chat.END)
    state, cost = 0, 0
    for role, label in zip(known, path):
        cost += chat.STEPS[state, label][0] + chat.label_cost(role, label)
        state = label
    assert cost + chat.END[state] == cheapest(roles)
    split = random.Random(len(roles)).randrange(len(roles) + 1)
    m = [np.array(chat.matrix(known[a:b])).reshape(4, 4) for a, b in ((0, split), (split, len(known)))]
    both = (m[0][:, :, None] + m[1][None, :, :]).min(axis=1)
    assert (both[0] + np.array(chat.END)).min() == cheapest(roles)


def conversation_text(rows):
    return "".join(r.rendered for r in sorted(rows, key=lambda r: r.position))


def test_chat_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", "a <|im_end|> b"), (2, 0, "assistant", "first"), (3, 5, None, "x"), (3, None, "bot", ""), (None, 1, "user", "lost"), (None, 1, "user", "lost"), (None, 2, "assistant", "x" * 100_000), (4, 0, "system", "s"), (4, 1, "user", "q"), (4, 1, "user", "q")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = chat.render(table).collect()
    assert len(got) == len(rows)
    text = lambda c: conversation_text([r for r in got if r.conv_id == c])
    assert text(1) == "<|im_start|>user\nhi\n<|im_end|>\n<|im_start|>assistant\na <| im_end|> b<|im_end|>\n"
    assert text(2) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nfirst<|im_end|>\n"
    assert text(3) == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text(4).endswith("<|im_start|>user\nq\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    # Rows of no conversation are conversations of their own.
    lost = sorted(r.rendered for r in got if r.conv_id is None)
    asked = "<|im_start|>user\nlost<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert lost == sorted([asked, asked, f"<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n{'x' * 100_000}<|im_end|>\n"])
    assert chat.render(table.filter("false")).count() == 0


def test_long_conversations_equal_short_work(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), f"{c}.{t}") for c in range(4) for t in range(40 if c else 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: (r.conv_id, r.position)
    whole = sorted(chat.render(table).collect(), key=key)
    monkeypatch.setattr(chat, "STRETCH", 7)
    assert sorted(chat.render(table).collect(), key=key) == whole


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies on this page, and this notice about them is really rather long.</p></div>
<div class="wrap"><aside><p>Side</p></aside><MAIN><h2>Title &amp; more</h2><p>First   para&nbsp;graph<br>with a <a href=x>link</a> and enough words.
<p>Short.<ul><li>one<li>two</ul><div class="ad-slot">Buy now</div><p>A second paragraph with many more words in it.</p></MAIN></div>
<section class="comments"><p>I liked this article and so I wrote this long comment about it for you to read.</p></section>
<form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""


def test_page():
    assert html_extract.main_text(PAGE) == "Title & more First para graph with a link and enough words. Short. one two A second paragraph with many more words in it."
    as_divs = PAGE.replace("<MAIN>", '<div class="x">').replace("</MAIN>", "</div>")
    assert html_extract.main_text(as_divs) == html_extract.main_text(PAGE)


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div><script>x", ""), ("<nav>x</nav>", ""), ("</p></div>ok", "ok"), ("<article><p>a</p>" + "<p>b</p>" * 3000 + "</article>", " ".join(["a"] + ["b"] * 3000))])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_pages_of_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = html_extract.extract(pages.withColumn("text", pages.url)).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("<(?:/?p|/?h1|br)>", body))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(odd).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


SENTENCE = "The quick brown fox jumps over the lazy dog and runs far away from it."
SOUP = f"""<div><div><a href=/>Home</a> <a href=/>News</a> <a href=/>Sport</a></div><div><div><h1>A title</h1></div><div><p>{SENTENCE} {SENTENCE}</p></div>
<div><p>Short.</p></div><div><p>{SENTENCE}</p></div></div><div><a href=/a>One</a><a href=/b>Two</a><a href=/c>Three</a><a href=/d>Four</a></div></div>"""


def test_each_step_of_the_method_decides(monkeypatch):
    """A page of nameless containers: the ratio tells text from links, smoothing saves the short line, the clusters cut."""
    want = f"A title {SENTENCE} {SENTENCE} Short. {SENTENCE}"
    assert html_extract.main_text(SOUP) == want
    with monkeypatch.context() as m:
        m.setattr(html_extract, "ratios", lambda sizes, tags: np.ones(len(sizes)))
        assert "Home" in html_extract.main_text(SOUP)
    with monkeypatch.context() as m:
        m.setattr(html_extract, "smooth", lambda values: values)
        assert "Short." not in html_extract.main_text(SOUP)
    for cut, found in ((-np.inf, True), (np.inf, False)):
        with monkeypatch.context() as m:
            m.setattr(html_extract, "threshold", lambda values: cut)
            assert ("Sport" in html_extract.main_text(SOUP)) == found and html_extract.main_text(SOUP) != want


def test_clusters_decide_on_the_pages_of_the_tables(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    texts = [html_extract.main_text(h) for h in pages]
    renamed = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]
    assert [html_extract.main_text(h) for h in renamed] == texts
    nameless = [h.replace(' class="ad"', "").replace("footer>", "div>").replace("nav>", "div>") for h in renamed]
    assert all(t in html_extract.main_text(h) for h, t in zip(nameless, texts))
    monkeypatch.setattr(html_extract, "threshold", lambda values: -np.inf)
    assert all(html_extract.main_text(h) != t for h, t in zip(pages, texts))


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>T</title><body><p>Hello", "Hello"),
        ("<html><head><title>T</title>Hello", "Hello"),
        (f'<div class="content-sidebar-wrap"><article>{SENTENCE}</article></div>', SENTENCE),
        (f'<form id="all"><div class="has-sidebar"><main>{SENTENCE}</main></div></form>', SENTENCE),
        (f'<article><p>{SENTENCE}</p><section id="related-work"><h2>Related work</h2><p>{SENTENCE}</p></section></article>', f"{SENTENCE} Related work {SENTENCE}"),
        ("<article><p>Press <button>Go</button> for <math>x+1</math> in <map>m</map>.</p></article>", "Press Go for x+1 in m."),
        (f"<div><h1>Title</h1><p>A lead.</p><div class=body>{SENTENCE} {SENTENCE}</div></div>", f"Title A lead. {SENTENCE} {SENTENCE}"),
        (f"<article>{SENTENCE}</article><article>{SENTENCE}</article>", f"{SENTENCE} {SENTENCE}"),
        (f"<article>{SENTENCE}</article><div id=comments><article class=comment>{SENTENCE} {SENTENCE}</article></div>", SENTENCE),
        (f"<div><p>{SENTENCE}</p><ul><li>one<li>two</ul><p>{SENTENCE}</p><div class=related><h3>Related</h3><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div></div>", f"{SENTENCE} one two {SENTENCE}"),
        (f"<article><header><h1>T</h1></header><p>{SENTENCE}</p><p hidden>no</p><aside>no</aside><footer>no</footer></article>", f"T {SENTENCE}"),
    ],
)
def test_pages_of_other_markup(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("part", ["<div>x", "<b>x", "<p>x", "<li>x", "<td>x", "<p><b>x", "</p></b>x"])
def test_deep_pages_take_linear_time(part):
    import time

    began = time.perf_counter()
    assert html_extract.main_text(part * 100_000).count("x") == 100_000
    assert time.perf_counter() - began < 20


def test_no_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, n_chars int")).collect() == []
