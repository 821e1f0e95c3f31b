"""Main text of HTML pages from flat text blocks and a small decision tree.

A page is read tag by tag into flat text blocks: block-level tags end a block,
all other tags and line breaks do not; scripts, styles, controls and other
unshown elements are skipped where they stand. A block's features are its word count and link density, those of
the blocks before and after it, whether it lies inside an article or main
element, whether the page has one, and whether it lies in a part that is
marked as a side part (navigation, footers, forms, or a class, id or role that
says advert, comments, cookie notice and the like). A decision tree (MLlib),
trained on the small labelled table below, says which blocks are main text.

Side words count as a whole class or at its end (``cookie-notice``; a place or
container after them may follow, as in ``comment-list``), but not in states
(``has-sidebar``, ``comments-open``). They never count on html, body, main and
article, nor on elements around them where the page's article would be lost.
Forms and hidden elements do not count around the page's article either, nor
where they hold most of a page that has none. A section's id that repeats its
own heading inside an article (``discussion``, ``widgets``) is an anchor and
says nothing, unless it speaks of comments, teasers or subscriptions; a
heading's id never does. A link stays open over block tags inside it (cards).

White space inside a block is one space, blocks are joined by line feeds in
page order, character references are decoded.

Defined cases: NULL or empty html has empty text; unclosed and stray tags,
unfinished tags and comments are read as browsers do (to the end of the page);
a ``<`` that opens no tag is text; pages without any article element are
judged by densities alone; repeated rows give equal results; an empty table
gives an empty result; further columns are ignored or carried unchanged.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from retailcast.llm.common import map_rows

# HTML elements that begin and end a line of text; all others stand in one.
BLOCK = frozenset("""address article aside blockquote body caption center colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
optgroup p pre search section summary table tbody td tfoot th thead tr ul""".split())
# Inline elements of HTML that are read past; other names are elements of their own (they may have marks).
INLINE = frozenset("""a abbr acronym area audio b bdi bdo big br cite code data del dfn em embed font i img input ins kbd
label link map mark meta meter output param picture progress q rb rp rt ruby s samp small source span strike strong sub
sup time track tt u var video wbr base col""".split())
# Elements whose content is no shown text.
SKIPPED = frozenset("script style noscript template title textarea svg iframe object select option canvas button".split())
# Elements that hold side parts, those that do so unless they hold the article, and those that hold it.
SIDE = frozenset("nav footer aside menu dialog".split())
LOOSE = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
# Words in class, id or role that mark a side part.
SIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adslot sponsor sponsored sponsors promo
promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe
subscription signup login share sharing social related recommended recommendations sidebar side widget widgets menu nav
navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus reply
replies respond discussion search pagination pager complementary contentinfo hidden""".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|\Z)""",
                   re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z0-9]+")
# Side words that mean it even where an id repeats its heading.
READERS = frozenset("""comment comments commentlist disqus reply replies respond related recommended recommendations
newsletter subscribe subscription signup login cookie cookies sponsored sponsors""".split())
# Elements whose class, id or role says no side part (it names the page's state or kind).
WHOLE = MAIN | {"html", "body"}
# Before a side word they make a state of it; after one they name its container or place.
STATES = frozenset("has have with without no not non hide show".split())
PLACES = frozenset("""area articles bar block blocks body box button buttons column container content entry footer form
group header heading holder icons info inner item items law left link links list main message outer panel posts primary
reading right row secondary section slot stories text this title top bottom trail unit wrap wrapper zone""".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "in_main", "has_main", "side")


def side_name(name: str) -> bool:
    """Whether one class (or id, or role) names a side part: a side word at its end, places and numbers aside."""
    parts = WORD.findall(name)
    while parts and parts[-1] not in SIDE_WORDS and (parts[-1] in PLACES or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in SIDE_WORDS and not STATES.intersection(parts)


@dataclass
class Element:
    """An open or closed element of a page: what it is and what its marks say."""

    tag: str
    parent: int          # index, or -1
    fixed: bool = False    # a side part by its tag
    loose: bool = False    # a form, or not shown
    named: bool = False    # a class or role says side part
    anchor: str = ""       # an id that says side part
    words: int = 0         # in it
    heading: str | None = None   # the words of the first heading in it


def read_element(tag: str, parent: int, attributes: str, in_main: bool) -> Element:
    e = Element(tag, parent, tag in SIDE or (tag == "header" and not in_main), tag in LOOSE)
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name in ("class", "role") and any(map(side_name, value.split())):
            e.named = True
        elif name == "id" and tag not in HEADINGS and any(map(side_name, value.split())):
            e.anchor = value
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            e.loose = True
    return e


def side_parts(elements: Sequence[Element]) -> list[bool]:
    """Whether each element lies in a side part.

    If names, forms or hidden elements would put every main element, or every
    article (of the main elements, if there are any) into side parts, they do
    not count on the elements around these. Else an article in a side part is
    a comment or a teaser. Without such elements, forms and hidden elements
    that hold over half of the page's words do not count.
    """
    inside: list[bool] = []    # a main element, or in one
    held: list[bool] = []      # an article or main element, or in one
    for e in elements:
        inside.append(e.tag == "main" or e.parent >= 0 and inside[e.parent])
        held.append(e.tag in MAIN or e.parent >= 0 and held[e.parent])
    total = sum(e.words for e in elements if e.parent < 0)
    loose, named = [], []
    for e, main in zip(elements, held):
        words = WORD.findall(e.anchor)
        anchor = bool(words) and not (main and words == WORD.findall(e.heading or "") and not READERS.intersection(words))
        named.append((e.named or anchor) and e.tag not in WHOLE)
        loose.append(e.loose and (any(held) or 2 * e.words <= total))

    def spread():
        side = []
        for i, e in enumerate(elements):
            side.append(e.fixed or loose[i] or named[i] or e.parent >= 0 and side[e.parent])
        return side

    side = spread()
    if not any(named) and not any(loose):
        return side
    mains = [i for i, e in enumerate(elements) if e.tag == "main"]
    articles = [i for i, e in enumerate(elements) if e.tag == "article" and (inside[i] or not mains)]
    unnamed = [i for i in articles if not (elements[i].named or elements[i].anchor)]   # one named comment is no page's article
    for found in (mains, unnamed if unnamed or mains else articles):
        if found and all(side[i] for i in found):
            seen = set()
            for i in found:
                while i >= 0 and i not in seen:
                    seen.add(i)
                    named[i] = loose[i] = False
                    i = elements[i].parent
            side = spread()
    return side


def text_blocks(page: str | None) -> list[dict]:
    """Flat blocks in page order: text, words, links (density), in_main, has_main, side, label."""
    page = page or ""
    blocks: list[dict] = []
    elements: list[Element] = []
    stack: list[tuple[str, bool, int, bool]] = []   # the open ones: tag, in_main, index, label
    parts: list[str] = []
    linked: list[str] = []
    link = -1   # number of elements open around the open link

    def end_block():
        text = " ".join("".join(parts).split())
        if text:
            words = len(text.split(" "))
            _, main, element, label = stack[-1] if stack else ("", False, -1, False)
            blocks.append({"text": text, "words": words, "in_main": main, "element": element, "label": label,
                           "links": min(1.0, len("".join(linked).split()) / words)})
            if element >= 0:
                elements[element].words += words
                if elements[element].tag in HEADINGS:
                    i = element
                    while i >= 0 and elements[i].heading is None:   # elements around one with a heading have one
                        elements[i].heading = text.lower()
                        i = elements[i].parent
        parts.clear()
        linked.clear()

    def add(raw):
        if raw:
            raw = entities.unescape(raw)
            parts.append(raw)
            if link >= 0:
                linked.append(raw + " ")

    def close(i):
        nonlocal link
        del stack[i:]
        if len(stack) < link:   # what the link stood in has ended
            link = -1

    at = 0
    while True:
        m = TOKEN.search(page, at)
        add(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        closing, tag, attributes, _ = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                link = -1 if closing else len(stack)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th"):   # such an element ends an open one of its kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] not in ("p", "li", "dt", "dd", "tr", "td", "th"):
                    break
        if attributes.endswith("/") or tag == "hr":
            continue
        _, main, parent, label = stack[-1] if stack else ("", False, -1, False)
        stack.append((tag, main or tag in MAIN, len(elements), label or "data-keep" in attributes))
        elements.append(read_element(tag, parent, attributes, main or tag in MAIN))
    end_block()
    for e in reversed(elements):   # children come after their parents
        if e.parent >= 0:
            elements[e.parent].words += e.words
    has_main = any(b["in_main"] for b in blocks)
    side = side_parts(elements)
    for b in blocks:
        element = b.pop("element")
        b["has_main"] = has_main
        b["side"] = element >= 0 and side[element]
    return blocks


def feature_rows(blocks: Sequence[dict]) -> list[tuple[float, ...]]:
    """One row of FEATURES per block; beyond the ends of the page are empty blocks."""
    none = {"words": 0, "links": 0.0}
    around = [none, *blocks, none]
    return [tuple(map(float, (b["words"], b["links"], p["words"], p["links"], n["words"], n["links"],
                              b["in_main"], b["has_main"], b["side"])))
            for p, b, n in zip(around, around[1:], around[2:])]


def _say(n: int) -> str:
    return " ".join(["word"] * n)


def labelled_pages() -> list[str]:
    """The training pages: blocks inside data-keep elements are main text, all others are not."""
    menu = "<ul>" + "".join(f'<li><a href="/{i}">{_say(1 + i % 3)}</a></li>' for i in range(6)) + "</ul>"
    lengths = ((9, 60, 1, 25, 3), (4, 2, 90, 14, 1), (12, 33, 7, 1, 45), (2, 5, 3, 6, 2))
    pages = []
    for k, sizes in enumerate(lengths):
        body = "".join(f"<p>{_say(n)}</p>" for n in sizes[1:])
        title = f"<h1>{_say(sizes[0])}</h1>"
        linked = f'<p>{_say(3 + k)} <a href="#">{_say(2 * k)}</a></p>'
        all_linked = f'<ul><li><a href="#">{_say(4)}</a></li></ul>'
        # side parts whose links are whole lines: menus, footers, teasers, comments
        lines = "".join(f'<li><a href="#">{_say(4 + (i + k) % 9)}</a></li>' for i in range(4))
        cards = "".join(f'<a href="#"><div>{_say(5 + 3 * i)}</div></a>' for i in range(3))
        lined = (f"<nav><ul>{lines}</ul></nav><aside class='related'>{lines}{cards}</aside><div class='comments'><p><a href='#'>"
                 f"{_say(6 + k)}</a></p><p>{_say(30)}</p></div><footer><p><a href='#'>{_say(5 + k)}</a></p>{lines}</footer>")
        side = (f'<div class="ad">{_say(6 + 9 * k)}</div><div class="notice">{_say(70 * k + 1)}</div>'
                f'<aside><p>{_say(30)}</p></aside>'
                f'<section class="comments"><p>{_say(20 + k)}</p><p>{_say(2)}</p></section><form>{_say(5)}</form>{lined}')
        # with an article element: all of it but its side parts, and nothing around it
        pages.append(f"<header>{_say(3)}</header><nav>{menu}</nav><div>{_say(8 + 9 * k)}</div>"
                     f"<article><div data-keep>{title}{body}{linked}{all_linked}</div>{side}</article>"
                     f"<div>{_say(20 + 60 * k)}</div>{menu}<footer><p>{_say(7 + 40 * k)}</p></footer>"
                     f"<p>{_say(50 + 90 * k)}</p><p>{_say(2 + k)}</p>")
        pages.append(f"<div>{menu}</div>{side}<p>{_say(120 * k + 44)}</p><p>{_say(70)}</p><main><div data-keep>{title}{body}</div>{side}</main>"
                     f"<div>{_say(4 + 12 * k)}</div>{side}")
        pages.append(f"<div>{_say(60)}</div><div>{_say(5 + k)}</div><article><div data-keep>{title}{body}"
                     f"<p>{_say(40 + k)}</p></div></article><div>{_say(3 + 4 * k)}</div><p>{_say(8 + 20 * k)}</p>"
                     f"<div>{_say(80)}</div><p>{_say(6 + 3 * k)}</p><div>{_say(50)}</div>{menu}")
        # fully linked lines: main text in the article, none around it
        pages.append(f"{lined}<article><div data-keep>{title}{lines}{all_linked}{body}{cards}</div>{lined}</article><div>{lines}{cards}</div>"
                     f"<p><a href='#'>{_say(4 + 2 * k)}</a></p>{lined}")
        # nothing but an article, of any length, and articles with blocks of any length around them
        pages.append(f"<article><div data-keep>{title}{body}</div></article>")
        for n in (1, 7, 30, 75, 160, 400):
            pages.append(f"<main><div data-keep><p>{_say(n + k)}</p></div></main>")
            pages.append(f"<article><div data-keep><p>{_say(2 * n + k)}</p>{all_linked}<p>{_say(n)}</p></div></article><p>{_say(n + 5 * k)}</p>")
            pages.append(f"<p>{_say(3 * n + k)}</p><p>{_say(n)}</p><article><div data-keep>{title}<p>{_say(n + 3)}</p></div></article>")
        # without one: long blocks with few links, and short ones between them
        long_body = "".join(f"<p>{_say(n)}</p>" for n in (30 + k, 45, 4 + k, 25, 60, 18 + k)) + (
            f'<p>{_say(24)} <a href="#">{_say(8 + 6 * k)}</a></p><p>{_say(33)}</p>')
        pages.append(f"<div>{menu}</div><div data-keep>{long_body}</div>{side}<div>{menu}</div>"
                     f"<p>{_say(6)}</p>{menu}<footer>{_say(9)}</footer>")
        pages.append(f"<nav>{_say(1 + k)}</nav><div data-keep>{long_body}</div><footer>{_say(1 + 2 * k)}</footer>{menu}")
        pages.append(f"{menu}<div data-keep><p>{_say(3 + k)}</p>{long_body}</div>{menu}")
        # classes that name a state of the page, or stand around its article
        pages.append(f'<body class="single has-sidebar comments-open"><nav>{menu}</nav><div class="page-with-sidebar menu-open">'
                     f'<article class="post hidden-print"><div data-keep>{title}{body}{linked}</div>{side}</article>'
                     f'<div>{_say(20 + 60 * k)}</div></div><div class="sidebar"><p>{_say(30)}</p></div></body>')
        pages.append(f'<body class="search sidebar"><div class="widget"><main id="related"><div data-keep>{title}{body}</div>'
                     f'{side}</main></div><div class="widget"><article>{_say(40)}</article></div><p>{_say(50 + k)}</p></body>')
        pages.append(f'<body class="menu"><div>{menu}</div><div class="with-sidebar comments-open"><div data-keep>{long_body}'
                     f'</div></div>{side}{menu}<div class="comment-list"><p>{_say(40 + k)}</p></div></body>')
    return pages


def train_tree(spark: SparkSession, depth: int = 8):
    """The decision tree as nested tuples (feature, threshold, left, right), leaves True or False."""
    rows = []
    for page in labelled_pages():
        blocks = text_blocks(page)
        rows += [(float(b["label"]), Vectors.dense(f)) for b, f in zip(blocks, feature_rows(blocks))]
    fit = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(spark.createDataFrame(rows, ["label", "features"]))

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction() > 0.5
        split = node.split()
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())

    return read(fit._call_java("rootNode"))


def decide(tree, features: Sequence[float]) -> bool:
    while not isinstance(tree, bool):
        feature, threshold, left, right = tree
        tree = left if features[feature] <= threshold else right
    return tree


def main_text(tree, page: str | None) -> tuple[str, int, int]:
    """(text, number of blocks, number of main blocks) of one page."""
    blocks = text_blocks(page)
    kept = [b["text"] for b, f in zip(blocks, feature_rows(blocks)) if decide(tree, f)]
    return "\n".join(kept), len(blocks), len(kept)


def extract_text(pages: DataFrame, html: str = "html", carry: Sequence[str] | None = None,
                 tree=None) -> DataFrame:
    """Columns ``row`` (carried) and ``res``: text, n_blocks, n_main."""
    tree = train_tree(pages.sparkSession) if tree is None else tree

    def make():
        return lambda page: main_text(tree, page)

    fields = [("text", T.StringType()), ("n_blocks", T.LongType()), ("n_main", T.LongType())]
    return map_rows(pages, [html], make, fields, pages.columns if carry is None else carry)
