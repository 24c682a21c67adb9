"""Nothing of an article is dropped for its path; what is none of it still goes."""

import pytest

from linewave.llm import pages

TEXT = [f"Sentence {i}, with words; and marks. It goes on, and on, for a good while." for i in range(10)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
LEAD = "A lead of some length, which says what follows, and why one should read on, all in a single sentence of its own."
MENU = "<nav><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></nav>"


def found(inner, tag="article"):
    return pages.main_text(f"<body>{MENU}<{tag}>{inner}</{tag}><footer><p>Copyright, 2020. All rights reserved.</p></footer></body>").split("\n\n")


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize(
    "inner, want",
    [
        (f"<h1>Head</h1><p class=lead>{LEAD}</p>{BODY}", ["Head", LEAD, *TEXT]),
        (f"<h1>Head</h1>{BODY}<p class=end>{LEAD}</p>", ["Head", *TEXT, LEAD]),
        (f"<h1>Head</h1>{BODY}<div class=s1><p>Short.</p></div>{BODY}", ["Head", *TEXT, "Short.", *TEXT]),
        ("<h1>Head</h1>" + "".join(f"<p class=c{i}>{t}</p>" for i, t in enumerate(TEXT)), ["Head", *TEXT]),
        (f"<h1>Head</h1>{BODY}<p>Yes.</p><p>No.</p>{BODY}", ["Head", *TEXT, "Yes.", "No.", *TEXT]),
        (f"<h1>Head</h1><p>{LEAD}</p><dl><dt>What is it?<dd>This.<dt>And why?<dd>It is so.</dl>", ["Head", LEAD, "What is it?", "This.", "And why?", "It is so."]),
        (f"<h1>Head</h1>{BODY}<h2>Sources</h2><ul><li><a href=a>Smith 2010</a><li><a href=b>Jones 2011</a></ul>", ["Head", *TEXT, "Sources", "Smith 2010", "Jones 2011"]),
        *((f"<h1>Head</h1>{BODY}<section class={c}><h2>Part</h2><p>{LEAD}</p></section>{BODY}", ["Head", *TEXT, "Part", LEAD, *TEXT]) for c in ("social-history", "legal-basis", "share-price", "notice-of-motion", "search_history", "menuOfTheDay")),
        *((f"<h1>Head</h1>{BODY}<section class={c}><h2>Part</h2><p>{LEAD}</p></section>{BODY}", ["Head", *TEXT, *TEXT]) for c in ("related-posts", "share", "cookie_notice", "siteFooter")),
    ],
)
def test_all_of_the_article_stays(tag, inner, want):
    assert found(inner, tag) == want


def test_a_lead_in_a_header_stays_and_a_byline_goes():
    assert found(f"<header><h1>Head</h1><p>{LEAD}</p><p>By me</p></header>{BODY}") == ["Head", LEAD, *TEXT]


COMMENT = "I read this, and I liked it. A good deal of it, really; more than once."


@pytest.mark.parametrize(
    "comments",
    [
        "<section><h2>3 comments</h2>" + "".join(f"<div><b>Reader {c}</b><p>{COMMENT}</p></div>" for c in "abc") + "</section>",
        "<div>" + "".join(f"<div><b>Ann</b> 3 May 2020<p>{COMMENT}</p></div>" for _ in range(8)) + "</div>",
        "".join(f"<div><span>Ann says</span><p>{COMMENT}</p><p>{COMMENT}</p></div>" for _ in range(30)),
    ],
)
@pytest.mark.parametrize("within", [True, False])
def test_comments_without_names_go(comments, within):
    article = f"<h1>Head</h1>{BODY}"
    page = f"<div>{article}{comments}</div>" if within else f"<div>{article}</div>{comments}"
    assert pages.main_text(f"<body>{MENU}{page}</body>").split("\n\n") == ["Head", *TEXT]


def test_parts_under_a_name_line_are_no_comments():
    part = "".join(f"<div><b>Step {c}</b><p>{t}</p></div>" for c, t in zip("abc", TEXT))
    assert found(f"<h1>Head</h1>{BODY}{part}") == ["Head", *TEXT, *TEXT[:3]] or found(f"<h1>Head</h1>{BODY}{part}")[-1] == TEXT[2]


def test_spans_by_hand():
    blocks = pages.blocks_of("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    tree = pages._Tree([b.open for b in blocks])
    assert [p[:2] for p in tree.parts(tree.root)] == [(0, 3), (3, 4)]
    assert [p[:2] for p in tree.parts(tree.parts(tree.root)[0])] == [(0, 1), (1, 3)]
    assert pages.region(blocks, tree, {1, 2})[:2] == (1, 3) and pages.region(blocks, tree, {0, 1, 2})[:2] == (0, 3)
