"""HTML extraction and WARC archives."""

import json
import random
import time

import pytest

from quillgraph.llm import html_extract as H
from quillgraph.llm import warc as W


def page(i, words, extra=""):
    return f"<html><body><nav>menu {i}</nav><article><p>Share this story with your friends</p><p>{words} {i} {'and more words ' * 12}</p>{extra}</article><footer>f</footer></body></html>"


def test_article_only():
    assert H.extract('<nav>x</nav><main><p>A &amp; b<i>c</i>d<p>e<div class="comments">no</div><ul><li>one<li>two</ul><aside>z</aside>tail<form>q</form>') == "A & bcd\ne\none\ntwo\ntail"
    assert H.extract('<div class="cookie-notice">hi</div><div>text <b>bold</b>\n more</div> loose < 5 &copy; <span class="ad">buy</span> x') == "text bold more\nloose < 5 © x"
    assert H.extract("<script>var t='</p>';</script><style>p{}</style><article><h1>T</h1>a<br>b<!-- c -->d<p>e") == "T\na bd\ne"
    assert H.extract(None) == H.extract("") == H.extract("<nav>x") == ""
    assert H.extract("<head><title>t</title><meta charset=x><body><article>no end of head") == "no end of head"
    assert H.extract("<article>one</article><p>out</p><article>two</article>") == "one\nout\ntwo"
    assert H.extract("<article><p>&#233;&eacute;&amp;amp;</p></article>") == "éé&amp;"


def test_names_and_tags_are_an_aid_only():
    for name in ("no-sidebar", "with-sidebar", "article-header", "social-policy", "share-of-voters", "comments-on-law"):
        assert H.extract(f'<div class="{name}">kept</div><p>{"long text " * 20}</p>').startswith("kept"), name
    for name in ("sidebar", "sidebar-left", "comment-list", "siteHeader", "social_share_buttons", "ad"):
        assert H.extract(f'<div class="{name}">gone</div><p>{"long text " * 20}</p>').startswith("long"), name
    long = "the main text " * 30
    assert H.extract(f'<div class="sidebar"><p>{long}</p></div><p>short</p>') == f"{long.strip()}\nshort"
    assert H.extract(f"<main><h1>Headline</h1><article><p>{long}</p></article></main>").startswith("Headline\n")
    assert H.extract(f'<div><p>{long}</p></div><div><article class="teaser">card</article></div>') == f"{long.strip()}\ncard"
    assert H.extract("<article><header><h1>Title</h1></header><p>x</p></article><header>site</header>") == "Title\nx"
    assert H.extract("<div>" * 150 + "<nav>menu</nav>deep" + "</div>" * 150) == "deep"


def template(pages):
    packed = json.loads(H.induce(pages))
    tree, into = H.unpack(packed)[0], {}
    for p in pages:
        H.agreement(tree, H.parse(p), into)
    made = H.decide(packed, into)
    if made is None:
        return None
    packed, what = json.loads(made)
    return H.unpack(packed)[0], {int(k): v for k, v in what.items()}


def test_constant_nodes_become_template_and_varying_slots_stay():
    pages = [page(i, f"text{i}") for i in range(8)]
    known = template(pages)
    assert H.extract(page(99, "other"), known).split("\n")[0].startswith("other 99")
    assert "Share this story" in H.extract(page(99, "other"))
    assert "extra words" in H.extract(page(99, "other", "<p>extra words</p>"), known)
    assert template(pages[:3]) is None  # too few to tell
    assert H.induce([page(0, "same")] * 8) is None  # copies of one page
    copies = [f"<article><p>{'the same long article text ' * 9}</p><p>tail {i}</p></article>" for i in range(8)]
    assert template(copies) is None  # near copies are no evidence


def test_nothing_but_the_named_parts_goes():
    got = H.extract('<article><p>Let <math><mi>x</mi></math> be.</p><p hidden>unseen</p><noscript>plain</noscript><p><object>figure</object> <button>press</button> <svg><text>label</text><style>s{}</style></svg></p><form><button>send</button></form><select><option>o</select></article>')
    assert got == "Let x be.\nunseen\nplain\nfigure press label"
    links = lambda i: "".join(f"<li><a href=x>ref {w} {i}</a></li>" for w in ("one", "two", "three"))
    pages = [f"<article><p>{f'story {i} goes on ' * 9}</p><ul>{links(i)}</ul></article><div><a href=y>next {i}</a></div>" for i in range(8)]
    got = H.extract(pages[3], template(pages)).split("\n")
    assert got[1:] == ["ref one 3", "ref two 3", "ref three 3"]


def test_two_pages_settle_what_is_outside_articles():
    pages = [f"<div>Subscribe to our letter</div><article><p>{f'story {i} goes on ' * 9}</p><p>they share this</p></article>" for i in range(2)]
    assert H.extract(pages[0], template(pages)) == f"{'story 0 goes on ' * 9}".strip() + "\nthey share this"


def test_every_kind_of_page_aligns(spark, monkeypatch):
    """A host whose sixteen kinds of page have menus and notices of their own, in places without telling names."""
    monkeypatch.setattr(H, "EXEMPLARS", 1)
    kinds = "abcdefghijklmnop"

    def html(i):
        c = kinds[i % len(kinds)]
        menu = "".join(f'<span><a href="/{i}{k}">topic {i} {k}</a></span> ' for k in range(5))
        return f'<div class="k{c}"><div class="m{c}">{menu}</div><div class="t{c}"><p>{f"story {i} of kind {c} " * 20}</p></div><div class="f{c}">Written for readers of {c * 5}</div></div>'

    rows = [(i, f"http://h/{i}", html(i)) for i in range(160)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert r.text == f"story {r.page_id} of kind {kinds[r.page_id % 16]} " .strip() + f" story {r.page_id} of kind {kinds[r.page_id % 16]}" * 19, r
        assert "topic" in H.extract(html(r.page_id)) and "Written" in H.extract(html(r.page_id))  # names and tags do not tell


def test_menus_outside_tags_and_optional_notices():
    def site(i, notice):
        links = "".join(f'<span><a href="/{i}{k}">topic {i} {k}</a></span> ' for k in range(6))
        return f'<div><div class="q">{links}</div>{"<p>We use tracking files</p>" if notice else ""}<div class="t"><p>{f"story {i} goes on " * 20}</p><p>by <a href=x>author {i}</a>, writer</p></div></div>'

    pages = [site(i, i % 2) for i in range(16)]
    known = template(pages)
    got = H.extract(site(50, 1), known).split("\n")
    assert got == [f"{'story 50 goes on ' * 20}".strip(), "by author 50, writer"]
    assert H.extract(site(50, 1)).startswith("topic 50 0")


def test_named_region_that_holds_the_main_text_of_its_host_stays():
    pages = [f'<div class="sidebar"><p>{f"story {i} of the host " * (1 if i == 7 else 20)}</p></div><div class="ad">{f"buy now {i} "}</div><div>{"other " * (30 if i == 7 else 1)}{i}</div>' for i in range(8)]
    known = template(pages)
    assert "story 7" in H.extract(pages[7], known) and "buy" not in H.extract(pages[7], known)


def test_tree_matching_is_the_largest_alignment():
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return H.Node("", text=rng.choice("abc"))
        return H.Node(rng.choice(["p", "div"]), kids=[tree(depth - 1) for _ in range(rng.randrange(1, 4))])

    def best(a, b):
        if a.text is not None or b.text is not None:
            return 0 if a.text is None or b.text is None else 1 + (a.text == b.text)
        return 1 + lists(a.kids, b.kids) if a.symbol == b.symbol else 0

    def lists(xs, ys):  # every order-keeping alignment
        if not xs or not ys:
            return 0
        w = best(xs[0], ys[0])
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), w + lists(xs[1:], ys[1:]) if w else 0)

    for cells in (H._CELLS, 2):
        H._CELLS, held = cells, H._CELLS
        try:
            for _ in range(150):
                a, b = (H.Node("r", kids=[tree(3) for _ in range(rng.randrange(1, 6))]) for _ in range(2))
                pairs = H.matched(a, b)
                assert H.weight(a, b, {}) == best(a, b) == sum(1 + (x.text is not None and x.text == y.text) for x, y in pairs)
        finally:
            H._CELLS = held


def test_long_lists_are_aligned_whole():
    varying = lambda i, n: "".join(f"<p>line {i} {k}</p>" for k in range(n))
    pages = [f"<div>{varying(i, 400 + 50 * i)}<p>Subscribe to our letter</p></div>" for i in range(6)]
    got = H.extract(f"<div>{varying(77, 1500)}<p>Subscribe to our letter</p></div>", template(pages))
    assert got.endswith("line 77 1499") and got.count("\n") == 1499


def test_hard_markup_takes_linear_time():
    begin = time.time()
    for bad in ("<b>" * 60_000, "</i>" * 60_000, "<p>" * 60_000, '<a "' * 40_000, "<div>" * 40_000 + "deep", "<!-- " * 60_000, "<" * 100_000):
        H.extract(bad)
    assert "deep" in H.extract("<div>" * 500 + "deep")
    assert time.time() - begin < 30


def test_pages(spark):
    rows = [(i, f"http://h/{i}", page(i, f"t{i}")) for i in range(10)] + [(20, None, None), (21, "x", ""), (22, "http://k/", "<p>alone</p>"), (22, "http://k/", "<p>alone</p>")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, text int")
    got = H.extract_pages(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[20] == by[21] == "" and by[22] == "alone"
    assert all("Share this" not in by[i] and by[i].startswith(f"t{i}") for i in range(10))
    assert H.extract_pages(df.limit(0)).count() == 0
    known = H.host_templates(df).collect()
    assert [(r.host, r.n_text) for r in known] == [("h", 2)]
    # More hosts than may be broadcast: the same texts by a join.
    held, H.BROADCAST_HOSTS = H.BROADCAST_HOSTS, -1
    try:
        assert {(r.page_id, r.text) for r in H.extract_pages(df).collect()} == {(r.page_id, r.text) for r in got}
    finally:
        H.BROADCAST_HOSTS = held


BIG = "<p>é" + "x" * 2000


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 600)
    rows = [(1, "http://a/1", BIG), (2, None, BIG), (3, "u\r\n3", BIG), (3, "u3", BIG), (4, "d", None), (5, "e", "short"), (6, "f", "short"), (None, "g", BIG), (7, "h", BIG + "y"), (8, "i", "x" * 999), (9, "j", "x" * 999), (10, "k", "z" * 1000), (11, "l", "z" * 1000)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, digest int").repartition(3)
    final = W.dedup_archives(df, str(tmp_path))
    got = W.read_archives(spark, final).collect()
    assert len(got) == len(rows)
    assert sorted(r.page_id for r in got if r.record_type == "response" and r.page_id) == [3, 4, 5, 6, 7, 8, 9, 11]
    assert {r.refers_to for r in got if r.record_type == "revisit" and r.payload_bytes > 1500} == {3}
    assert [r.refers_to for r in got if r.page_id == 10] == [11]
    assert all(r.payload_bytes == len((dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()) for r in got)
    for r in got:
        if r.record_type == "response" and r.page_id not in (3, None):
            assert r.payload.decode() == (dict((a, c) for a, _, c in rows)[r.page_id] or "")
    assert W.read_archives(spark, W.dedup_archives(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_broken_archives_are_errors():
    raw = W.pack_record(1, "u", b"payload", "0" * 40, 7, "2024-01-01T00:00:00Z")
    assert len(list(W.members(raw + raw))) == 2
    with pytest.raises(ValueError):
        list(W.members(raw[:-4]))
