"""Main text where declared regions and the text disagree."""

import pytest

from linewave.llm import pages

LONG = [f"Sentence {i}, with words; and marks. It goes on, and on, for a good while." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in LONG)
CARDS = "<article><h3>One more</h3><p>Read it.</p></article><article><h3>And another</h3><p>See this.</p></article>"


@pytest.mark.parametrize("tag", ["main", "div"])
@pytest.mark.parametrize("first", [True, False])
def test_cards_in_articles_do_not_take_the_place_of_the_text(tag, first):
    text = f"<{tag}><h1>Head</h1>{BODY}</{tag}>"
    page = f"<body>{CARDS if first else ''}{text}{'' if first else CARDS}</body>"
    assert pages.main_text(page).split("\n\n") == ["Head", *LONG]


def test_an_article_keeps_short_text_out_that_stands_beside_it():
    page = f"<body><div><p>Short, here.</p></div><article><h1>Head</h1>{BODY}<ul><li>Item</ul></article><div>Short</div></body>"
    assert pages.main_text(page).split("\n\n") == ["Head", *LONG, "Item"]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_headings_with_a_link_stay_and_those_of_link_lists_go(tag):
    page = f"<body><{tag}><h1><a href=1>Head</a></h1>{BODY}<h2><a href=2>Part</a></h2>{BODY}<h3><a href=5>More</a></h3><ul><li><a href=3>Three</a><li><a href=4>Four</a></ul></{tag}></body>"
    assert pages.main_text(page).split("\n\n") == ["Head", *LONG, "Part", *LONG]


def test_the_threshold_decides_on_paths_below_the_chosen_ones():
    page = f"<body><div id=w>{BODY}<section>{BODY}</section><div class=meta><div>Tag</div><div>More</div><div>Two</div></div></div></body>"
    assert pages.main_text(page).split("\n\n") == [*LONG, *LONG]


def test_lists_that_go_on_from_the_text_stay():
    page = f"<body><div id=w>{BODY}<ul><li>One<li>Two</ul>{BODY}</div><ul><li>Out</ul></body>"
    assert pages.main_text(page).split("\n\n") == [*LONG, "One", "Two", *LONG]


def test_deep_paths_are_told_apart():
    (a, *_), (b, *_), (c, *_) = pages.blocks_of("<div>" * 40 + "<div class=a><p>x</p><p>y</p></div><div class=b><p>z</p></div>")
    assert a == b != c
    ((*_, regions),) = pages.blocks_of("<div>" * 40 + "<main><p>x")
    assert regions == (False, True)
