"""Main text through path ratios: without what the markup declares, and against it."""

import re
import time
from collections import Counter
from html import unescape

import pandas as pd
import pytest

from linewave.llm import pages

TEXT = [f"Sentence {i}, with words; and marks. It goes on, and on, for a good while." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
COMMENTS = "".join(f"<div class=comment><p>Reader {i} says this, and that. A good deal of it, really; more than once.</p></div>" for i in range(40))


def wanted(html):
    """Blocks of the test data's article."""
    inner = html[html.index("<article>") + 9 :].split("</article>")[0]
    parts = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return [p for p in parts if p]


def neutral(html):
    """The page with ``div`` for all elements that tell something, and without class, id and role."""
    html = re.sub(r"(?i)<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", html)
    return re.sub(r" (class|id|role)=\"[^\"]*\"", "", html)


def precision_and_recall(htmls):
    right = found = want = 0
    for h in htmls:
        t, g = wanted(h), [b for b in pages.main_text(neutral(h)).split("\n\n") if b]
        right, found, want = right + sum((Counter(t) & Counter(g)).values()), found + len(g), want + len(t)
    return right / max(found, 1), right / want


@pytest.fixture(scope="module")
def htmls():
    return list(pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html)


def test_ratios_alone_find_the_blocks(htmls):
    precision, recall = precision_and_recall(htmls)
    assert precision >= 0.95 and recall >= 0.95


def test_without_ratios_the_blocks_are_not_found(htmls, monkeypatch):
    monkeypatch.setattr(pages, "path_ratio", lambda sums: 1.0)
    precision, recall = precision_and_recall(htmls)
    assert precision < 0.9 or recall < 0.9


def test_ratio_by_hand():
    own = pages._Sums()
    for text, links in (("abcd, efgh.", 0), ("abc", 3)):
        own.blocks, own.chars, own.squares = own.blocks + 1, own.chars + len(text), own.squares + len(text) ** 2
        own.marks, own.links = own.marks + len(pages.PUNCTUATION.findall(text)), own.links + links
    from math import log

    assert pages.path_ratio(own) == pytest.approx(log(1 + 11 / 2) + log(1 + 2 / 2) + 0.25 * log(1 + 4) + 2 * log(1.01 - 3 / 14))


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>Head</h1>{BODY}<section class=comments>{COMMENTS}</section></article>",
        f"<div id=c><h1>Head</h1>{BODY}</div><div id=comments>{COMMENTS}</div>",
        f"<form><div><h1>Head</h1>{BODY}</div><button>Send</button><select><option>One<option>Two</select></form>",
        f"<div><h1>Head</h1>{BODY}</div><div class=sidebar><p>About me: I write, a lot, about things. Really a lot of it, every day.</p></div>",
        f"<header><h1>Site</h1></header><article><header><h1>Head</h1><p>By me</p></header>{BODY}<footer>tags</footer></article>",
        f"<article><h1>Head</h1><div class=notice>We use cookies, on this site, to make it better. Accept or leave, as you like.</div>{BODY}</article>",
        f"<article><h1>Head</h1>{BODY}<div hidden><p>{TEXT[0]}</p></div></article>",
    ],
)
def test_text_beside_what_is_none(page):
    assert pages.main_text(f"<body>{page}</body>").split("\n\n") == ["Head", *TEXT]


def test_long_text_in_a_misnamed_element_stays():
    page = f"<body><nav><ul><li><a href=1>a</a></ul></nav><div class=sidebar-left><h1>Head</h1>{BODY * 8}</div><p>Copyright. 2020.</p></body>"
    assert pages.main_text(page).split("\n\n")[:49] == ["Head", *TEXT * 8]


def test_deep_pages_take_time_by_their_length():
    began = time.perf_counter()
    blocks = pages.blocks_of("<div>x" * 100_000)
    assert (len(blocks), blocks[-1].depth, blocks[-1].shared) == (100_000, 100_000, 99_999)
    assert len(pages.content(blocks)) == 100_000
    assert len(pages.blocks_of("<ul>" + "<b>" * 10 + "<section>" * 50_000 + "<li>y" * 1000)) == 1000
    assert time.perf_counter() - began < 30
