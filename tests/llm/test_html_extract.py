"""HTML extraction: template pages, other page shapes, broken markup."""

import html
import re

import pytest

from retailcast.llm import html_extract as H


@pytest.fixture(scope="module")
def tree(spark):
    return H.train_tree(spark)


def text(tree, page):
    return H.main_text(tree, page)[0]


LONG = " ".join(["plain"] * 40)


def test_the_tree_learned_its_table(tree):
    for page in H.labelled_pages():
        blocks = H.text_blocks(page)
        wrong = [b for b, f in zip(blocks, H.feature_rows(blocks)) if H.decide(tree, f) != b["label"]]
        assert len(wrong) <= 0.05 * len(blocks)


def test_pages_of_the_table(spark, tree):
    """The article's blocks, cut out by pattern, are the brute-force form for these pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_text(pages, tree=tree).select("row.page_id", "res.text").collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split())
                 for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_side_parts(tree):
    page = f"""<html><head><title>T</title><style>p {{}}</style><script>var x = "<p>no</p>";</script></head><body>
    <header><p>Site name</p></header><nav><a href="/">home</a></nav><div id="cookie-notice">We use cookies</div>
    <article><h1>Title</h1><p>First &amp; <b>bold</b>\n  text.</p><aside>Sidebar words</aside>
    <div class="ad">Buy now</div><p>{LONG}</p><!-- <p>hidden</p> --><form><input value="x">Sign up</form>
    <p>Short.</p><section class="comments"><p>{LONG} comment</p></section></article>
    <div class="sidebar"><p>{LONG}</p></div><p>{LONG} {LONG}</p><footer>&copy; 2020</footer></body></html>"""
    assert text(tree, page) == f"Title\nFirst & bold text.\n{LONG}\nShort."


@pytest.mark.parametrize("around", [
    "<body class='single has-sidebar'><article>{}</article></body>", "<body class='comments-open'><article>{}</article>",
    "<html class='menu'><body id='search' class='sidebar'><main>{}</main>", "<article class='post hidden-print'>{}</article>",
    "<article class='sidebar'>{}</article>", "<main role='complementary'>{}</main>",
    "<div class='menu-open'><article>{}</article></div>", "<div class='page-with-sidebar'><div><main>{}</main></div></div>",
    "<div id='sidebar' class='widget'><article>{}</article></div>", "<main><div class='notice'><article>{}</article></div></main>",
    "<div class='side'><article class='promo'>{}</article></div>",
    "<div class='widget'><article>{}</article></div><div class='widget'><article></article></div>",
    "<body class='sidebar'><div class='no-sidebar search-open'>{}</div></body>"])
def test_classes_of_the_page_and_around_its_article(tree, around):
    body = f"<p>{LONG} one</p><p>{LONG} two</p><div class='cookie-notice'>{LONG}</div><ul class='comment-list'>{LONG}</ul>"
    assert text(tree, around.format(body)) == f"{LONG} one\n{LONG} two"


def test_articles_in_side_parts_are_comments_and_teasers(tree):
    body = f"<p>{LONG} one</p>"
    comments = f"<section class='comments'><article>{LONG}</article><article class='comment'>{LONG}</article></section>"
    for page in (f"<article>{body}{comments}</article>", f"<article>{body}</article>{comments}",
                 f"<div class='sidebar'><article>{LONG}</article></div><main>{body}</main>",
                 f"<main>{body}<div class='comments'><article id='comment-12'>{LONG}</article></div></main>",
                 f"<aside><article>{LONG}</article></aside><article>{body}</article>"):
        assert text(tree, page) == f"{LONG} one"


def test_pages_without_an_article_element(tree):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(8)) + "</ul>"
    page = f"<div>{menu}</div><div><p>{LONG} one</p><p>{LONG} two</p><p>{LONG} three</p></div><footer>end</footer>"
    assert text(tree, page) == f"{LONG} one\n{LONG} two\n{LONG} three"


@pytest.mark.parametrize("page, expected", [
    (None, ""), ("", ""), ("   ", ""), ("<article>open <p>and never closed", "open\nand never closed"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("<article><p>cut <b", "cut"), ("<article><p>x<!-- open comment", "x"), ("<article></p></div>stray</article>", "stray"),
    ("<ARTICLE><P>Upper&nbsp;case &eacute;&#233;&#x1F600;</P></ARTICLE>", "Upper case éé\U0001f600"),
    ('<article><p title="a > b">quoted</p></article>', "quoted"), ("<article><script>never closed", ""),
    ("<article><p>one<br>two</p><p></p><p> </p></article>", "one two"),
])
def test_edges(tree, page, expected):
    assert text(tree, page) == expected


def test_deep_and_long_pages(tree):
    assert text(tree, "<article>" + "<div>" * 5000 + "deep") == "deep"
    assert text(tree, "<article>" + "<p>w</p>" * 20000) == "\n".join(["w"] * 20000)


def test_frames(spark, tree):
    df = spark.createDataFrame([(1, None, "x", "x"), (1, None, "x", "x"), (2, "<main>m</main>", "x", "x")],
                               "page_id long, html string, text string, row string")
    out = H.extract_text(df, tree=tree).select("row.page_id", "res.text").collect()
    assert sorted((r.page_id, r.text) for r in out) == [(1, ""), (1, ""), (2, "m")]
    assert H.extract_text(df.limit(0), tree=tree).count() == 0


def test_side_parts_are_never_main(tree):
    """No leaf that a block of a side part, or one beside the page's article, can reach says main text."""
    side, in_main, has_main = (H.FEATURES.index(c) for c in ("side", "in_main", "has_main"))

    def leaves(node, fixed):
        if isinstance(node, bool):
            yield node
            return
        feature, threshold, left, right = node
        if feature in fixed:
            yield from leaves(left if fixed[feature] <= threshold else right, fixed)
        else:
            yield from leaves(left, fixed)
            yield from leaves(right, fixed)

    assert not any(leaves(tree, {side: 1.0}))
    assert not any(leaves(tree, {in_main: 0.0, has_main: 1.0}))
    assert all(leaves(tree, {side: 0.0, in_main: 1.0, has_main: 1.0}))   # and the article loses no block


LINE = "Read our privacy policy and all other terms here"


@pytest.mark.parametrize("part", [
    "<nav><ul><li><a>Home</a></li><li><a>{}</a></li></ul></nav>", "<footer><p><a>{}</a></p></footer>",
    "<aside class=related><a>{}</a></aside>", "<div class=comments><p><a>{}</a></p></div>",
    "<aside><a href='/x'><div><h3>{}</h3><p>{}</p></div></a></aside>", "<ul class='menu'><li><a>{}</a></li></ul>",
    "<x-comments class='comments'><p>{}</p></x-comments>", "<section id='comments'><h2>Comments</h2><p>{}</p></section>",
    "<section id='related'><h2>Related</h2><p>{}</p></section>", "<div id='sidebar'><p>{}</p></div>",
    "<form><p>{}</p></form>", "<div style='display: none'>{}</div>", "<div aria-hidden='true'><p>{}</p></div>"])
def test_linked_lines_of_side_parts(tree, part):
    part = part.replace("{}", LINE)
    body = f"<p>{LONG} one</p><p>{LONG} two</p>"
    for page in (f"{part}<article>{body}</article>", f"<article>{body}{part}</article>", f"<article>{body}</article>{part}",
                 f"<main>{part}{body}</main>{part}", f"<body><div>{part}</div><div>{body}</div>{part}</body>"):
        assert text(tree, page) == f"{LONG} one\n{LONG} two", page


@pytest.mark.parametrize("around", [
    "<form id='aspnetForm'>{}</form>", "<body style='display:none'>{}</body>", "<div aria-hidden='true'><div>{}</div></div>",
    "<form class='page'><fieldset>{}</fieldset></form>"])
def test_pages_inside_forms_or_hidden_until_loaded(tree, around):
    body = f"<p>{LONG} one</p><p>{LONG} two</p>"
    for inner in (f"<article>{body}</article><form><p>Your name</p></form>", f"<main>{body}</main>", f"<div>{body}</div>"):
        assert text(tree, around.format(inner)) == f"{LONG} one\n{LONG} two"


def test_ids_that_repeat_a_heading_are_anchors(tree):
    for kind in ("article", "main"):
        page = (f"<{kind}><h1>Paper</h1><section id='discussion'><h2>Discussion</h2><p>{LONG} one</p></section>"
                f"<section id='widgets'><div><h3>Widgets</h3></div><p>{LONG} two</p></section><h2 id='related'>Related</h2>"
                f"<p>{LONG} three</p></{kind}>")
        assert text(tree, page) == f"Paper\nDiscussion\n{LONG} one\nWidgets\n{LONG} two\nRelated\n{LONG} three"
    assert text(tree, f"<article><p>{LONG}</p><section id='discussion'><h2>12 replies</h2><p>{LONG}</p></section></article>") == LONG


@pytest.mark.parametrize("page, expected", [
    ("<p>Hello <script>var a = '<p>';</script>brave <svg><text>no</text></svg>new</p>", "Hello brave new"),
    ("<p>Press <button><b>Share</b></button> now</p>", "Press now"), ("<p>a <iframe src=x>no</iframe>b</p>", "a b"),
    ("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>", "let x=2 hold"),
    ("<p>my <x-term>own</x-term> element</p>", "my own element"), ("<p>one</p><script>x</script><p>two</p>", "one\ntwo"),
    ("<p>un<wbr>broken</p><p>pic <img src=x> ture</p>", "unbroken\npic ture"), ("<div>a<hr>b</div>", "a\nb"),
    ("<p>x <select><option>no</select> y</p>", "x y"), ("<noscript><p>no</p></noscript><p>yes</p>", "yes")])
def test_what_stands_in_a_line_does_not_cut_it(tree, page, expected):
    assert text(tree, f"<article>{page}</article>") == expected


def test_linked_words_in_pages_without_an_article_element(tree):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(8)) + "</ul>"
    some = " ".join(["some <a href=x>linked words</a> and plain ones"] * 8)
    plain = re.sub("<[^>]*>", "", some)
    page = f"<div>{menu}</div><div><p>{LONG}</p><p>{some}</p><p>{LONG}</p></div><div>{menu}</div>"
    assert text(tree, page) == f"{LONG}\n{plain}\n{LONG}"


def test_links_over_blocks():
    def links(page):
        return [b["links"] for b in H.text_blocks(page)]

    assert links("<a href=x><div>one two</div><p>three</p></a><p>four</p>") == [1.0, 1.0, 0.0]
    assert links("<div><a href=x>never closed</div><p>text after it</p>") == [1.0, 0.0]
    assert links("<p><a>one</a> two</p>") == [0.5]
