"""Main text of web pages by tag-path ratios (operator 6).

A page is cut into blocks of text; each block has a root-to-leaf path of block-level tags. For every path
four figures are gathered over its blocks: characters a block, punctuation marks a block, the spread of the blocks'
lengths, and the share of link text. Their logarithms are added up to the path's ratio; ratios are smoothed over
neighbouring blocks as far as their paths agree, and fused with what the markup itself declares: a path that is set
aside by its names loses a fixed amount, one in an article or main element gains one. Paths whose score
comes near the page's mean are the content.

The chosen paths mark where the text is: the innermost element that holds most of their text is the page's region. Within it all
text stays, whatever its path (a lead, short paragraphs, definitions, lists of sources), but for what its own names, its
links or its form as a run of comments set apart. So a path that is seldom used loses no text to the smoothing.

Nothing in the markup but ``hidden`` decides by itself: without any class names and with ``div`` for all elements
that tell something, the ratios find the same text on most pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import exp, log, log1p, sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import slices

# Element kinds of HTML, as its standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp svg math template object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table menu select body html article section div".split())
# A choice of tags, names and roles by which pages commonly mark what is not their text; they lower a score.
ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu head fieldset search audio video".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer "
    "gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words that, joined with one of the names, still name such a part: ``site-footer``, but not ``social-history``.
JOINED_NAMES = frozenset(
    "area bar block body bottom box btn button buttons col column container content global group header heading icon icons inner item items left link links list main message outer "
    "page panel post posts primary right row secondary section site stories thread title top widget wrap wrapper".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption summary address center".split())
COMMENTS = re.compile(r"(?i)\s*[(\d.,)\s]*(comments?|reader comments?|replies|responses|discussion|kommentare?|commentaires?|comentarios|comentários)[\s(\d.,)]*:?\s*")
SAYS = re.compile(r"(?i)\d|\b(says|said|wrote|writes|ago|schrieb|sagt|dit|écrit|dice|dijo)\b")
SENTENCE = re.compile(r"[.!?…。！？:][\"'»”’)\]]*$")
#: Share of the chosen paths' text that the region holds, and records in a row that make a run of comments.
REGION_SHARE, RECORDS = 0.75, 3
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")

# Possessive throughout: no input makes them go back.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
REGIONS = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
#: What a path's score, a sum of logarithms, loses where the markup sets it aside, and gains in an article or main element.
ASIDE_LOSS, REGION_GAIN = 3.5, 1.0
#: How far below the page's mean score the content goes, as a logarithm.
NEAR_MEAN = 0.5
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """A block of text and what its path says; levels count from the root."""

    path: int  # number of its path among the page's distinct paths of names
    depth: int  # levels of its path
    base: int  # levels of them that are html or body
    shared: int  # levels that its path has in common with that of the block before
    outer: int  # levels above the run of list and table elements that ends its path
    heading: int  # levels from a heading up to the element that it is the heading of; 0: no heading
    aside: bool
    text: str
    links: int  # characters of link text
    tag: str  # of the innermost element
    open: int  # levels whose elements have stayed open since the block before
    asides: int  # elements around it that are set aside
    headed: bool  # within a header
    regions: tuple[bool, ...]  # whether within each of REGIONS


class _Open(NamedTuple):
    """An open element."""

    tag: str
    name: str
    aside: bool
    hidden: bool
    path: int
    base: int
    outer: int


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """Path name of an element, whether its names set it aside from the text, and whether it is hidden."""
    aside, hidden = tag in ASIDE_TAGS or (tag == "header" and not in_article), False
    name = tag
    if attributes.strip(" /"):
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        label = found.get("class") or found.get("id") or ""
        name = f"{tag}.{label.split()[0]}" if label.split() else tag
        if tag not in ("html", "body", "main"):
            names = [{w.lower() for w in _NAME.findall(token)} for token in f"{found.get('class', '')} {found.get('id', '')}".split()]
            aside = aside or any(own & ASIDE_NAMES and own <= ASIDE_NAMES | JOINED_NAMES for own in names) or (not in_article and any("header" in own and own <= {"header", "site", "page", "top", "main"} for own in names))
            aside = aside or found.get("role", "").lower() in ASIDE_ROLES
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    return name, aside, hidden


def blocks_of(html: str) -> list[Block]:
    """The blocks of text in page order.

    Text runs on through inline elements; white space becomes one space; character references are decoded.
    Comments, raw-text and hidden elements and a tag cut off by the end of the page give no text. Paths of any depth
    are told apart: a path is a number, made of its parent's and its last name.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    paths: dict[tuple[int, str], int] = {}
    where: dict[str, list[int]] = {}  # places of the open elements of each tag
    scopes: list[int] = []  # and of those that optional end tags do not reach beyond
    text: list[str] = []
    links = in_link = set_aside = hidden = 0
    before: list[str] = []  # names of the last block's path
    least = 0  # levels that have stayed open since
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal links, least
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words and not hidden:
                stayed = same = min(least, len(before))
                while same < min(len(stack), len(before)) and stack[same].name == before[same]:
                    same += 1
                before[same:] = [s.name for s in stack[same:]]
                least = len(stack)
                top = stack[-1] if stack else _Open("", "", False, False, 0, 0, 0)
                heading = 0 if top.tag not in HEADINGS else 2 if len(stack) > 1 and stack[-2].tag in ("header", "hgroup") else 1
                out.append(Block(top.path, len(stack), top.base, same, top.outer, heading, set_aside > 0, words, min(links, len(words)), top.tag, stayed, set_aside, bool(where.get("header")), tuple(bool(where.get(r)) for r in REGIONS)))
            text.clear()
        links = 0

    def close(levels: int) -> None:
        """End elements until ``levels`` are open."""
        nonlocal set_aside, hidden, least
        while len(stack) > levels:
            gone = stack.pop()
            where[gone.tag].pop()
            if gone.tag in SCOPES:
                scopes.pop()
            set_aside -= gone.aside
            hidden -= gone.hidden
        least = min(least, levels)

    def end_siblings(tags: tuple[str, ...]) -> None:
        """End the run of such elements that is open within the innermost scope."""
        last = max((where[t][-1] for t in tags if where.get(t)), default=-1)
        if last >= 0 and last > (scopes[-1] if scopes else -1):
            while last and stack[last - 1].tag in tags:
                last -= 1
            close(last)

    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            part = html[at:cut]
            text.append(part)
            links += len(part) if in_link else 0
        if cut == n:
            break
        at = cut
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = n if end < 0 else end + 3
            continue
        follow = html[at + 1 : at + 2]
        if follow in ("!", "?") or (follow == "/" and not html[at + 2 : at + 3].isalpha()):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        if not (follow.isascii() and follow.isalpha()) and follow != "/":
            text.append("<")
            at += 1
            continue
        m = _TAG.match(html, at) or _PLAIN_TAG.match(html, at)
        if not m:
            break  # cut off inside a tag
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in INLINE:
                in_link -= tag == "a" and in_link > 0
            elif where.get(tag):
                flush()
                close(where[tag][-1])
                in_link = 0
            elif tag == "p" or tag == "br":
                flush() if tag == "p" else text.append(" ")
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" " if tag in ("br", "wbr", "img", "input") and tag != "wbr" else "")
            continue
        if tag in INLINE:
            in_link += tag == "a"
            continue
        flush()
        in_link = 0
        if tag in CLOSES_P and where.get("p"):
            close(where["p"][-1])
        if tag in SIBLINGS:
            end_siblings(SIBLINGS[tag])
        name, aside, unseen = _marks(tag, m[3], bool(where.get("article") or where.get("main")))
        above = stack[-1] if stack else None
        path = paths.setdefault((above.path if above else 0, name), len(paths) + 1)
        base = len(stack) + 1 if tag in ("html", "body") else above.base if above else 0
        outer = (above.outer if above else 0) if tag in ITEMS else len(stack) + 1
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(_Open(tag, name, aside, unseen, path, base, outer))
        set_aside += aside
        hidden += unseen
    flush()
    return out


class _Sums:
    """Figures of one path, added up over its blocks."""

    def __init__(self) -> None:
        self.blocks = self.chars = self.squares = self.marks = self.links = 0
        self.declared = self.smooth = 0.0


def path_ratio(sums: _Sums) -> float:
    """A path's ratio: logarithms of length, punctuation and spread a block, and of the share that is no link."""
    plain = (sums.chars - sums.links) / sums.blocks
    spread = sqrt(max(0.0, sums.squares / sums.blocks - (sums.chars / sums.blocks) ** 2))
    return log1p(plain) + log1p(sums.marks / sums.blocks) + 0.25 * log1p(spread) + 2 * log(1.01 - sums.links / sums.chars)


class _Tree:
    """Blocks as nested elements: spans of blocks, cut where fewer levels have stayed open than anywhere else in the span.

    Made in one pass; a span is (first, end, its cut), the cut being -1 in a span of one block.
    """

    def __init__(self, opened: list[int]):
        n = len(opened)
        self.opened, self.left, self.right = opened, [-1] * n, [-1] * n
        spine: list[int] = []
        for k in range(1, n):
            last = -1
            while spine and opened[spine[-1]] > opened[k]:
                last = spine.pop()
            self.left[k] = last
            if spine:
                self.right[spine[-1]] = k
            spine.append(k)
        self.root = (0, n, spine[0] if spine else -1)

    def parts(self, span: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        """The elements that a span's blocks lie in, one level below what they all have in common."""
        lo, hi, cut = span
        if cut < 0:
            return []
        out, level = [], self.opened[cut]
        while cut >= 0 and self.opened[cut] == level:
            out.append((lo, cut, self.left[cut]))
            lo, cut = cut, self.right[cut]
        return [*out, (lo, hi, cut)]


def region(blocks: list[Block], tree: _Tree, chosen: set[int]) -> tuple[int, int, int]:
    """The innermost element of more than one block that holds :data:`REGION_SHARE` of the chosen blocks' text."""
    before = [0]
    for i, b in enumerate(blocks):
        before.append(before[-1] + (len(b.text) - b.links if i in chosen else 0))
    span = tree.root
    while True:
        for part in tree.parts(span):
            if part[1] - part[0] > 1 and before[part[1]] - before[part[0]] >= REGION_SHARE * before[-1]:
                span = part
                break
        else:
            return span


def comments_of(blocks: list[Block], tree: _Tree, inside: tuple[int, int, int], kept: set[int]) -> set[int]:
    """Blocks of readers' comments that nothing names: what follows a heading such as "3 comments" within its element or the region,
    and :data:`RECORDS` elements in a row, behind some of the text, that all begin with a line on the same path with a time or "says".
    """
    out: set[int] = set()
    for i, b in enumerate(blocks):
        if i and b.heading and COMMENTS.fullmatch(b.text):
            levels = b.depth - b.heading
            j = i + 1
            while j < len(blocks) and blocks[j].open >= levels and not (blocks[j].heading and blocks[j].depth <= b.depth and blocks[j].tag <= b.tag):
                j += 1
            out.update(range(i, j))
    # An element that begins with a line such as a name and a time, and goes on with sentences.
    sentences = [0]
    for b in blocks:
        sentences.append(sentences[-1] + bool(SENTENCE.search(b.text)))
    line = [not b.heading and b.tag not in ITEMS and len(b.text) <= 80 and after == before for b, before, after in zip(blocks, sentences, sentences[1:])]
    first_kept = min(kept, default=len(blocks))
    stack = [tree.root]
    while stack:
        parts, run = tree.parts(stack.pop()), []
        for part in [*parts, None]:
            fits = part is not None and line[part[0]] and sentences[part[1]] > sentences[part[0]] and (not run or blocks[part[0]].path == blocks[run[0][0]].path)
            if fits:
                run.append(part)
                continue
            if len(run) >= RECORDS and all(SAYS.search(blocks[r[0]].text) for r in run) and first_kept < run[0][0]:
                out.update(range(run[0][0], run[-1][1]))
            else:
                stack += [r for r in run if r[2] >= 0]
            run = []
            if part is not None and part[2] >= 0:
                stack.append(part)
    return out


def _text_of_region(blocks: list[Block], inside: tuple[int, int, int]) -> Iterator[int]:
    """Blocks of the region that are text: of a text element, or with punctuation; neither set aside within it nor a line of names in a header.

    A run of links is text as the items of a list that text leads to, such as sources; under a linked heading it is none.
    """
    lo, hi, _ = inside
    level = min(b.asides for b in blocks[lo:hi])
    led = False
    for i in range(lo, hi):
        b = blocks[i]
        if b.asides > level:
            continue
        if 10 * b.links >= 9 * len(b.text):
            led = led and b.tag in ITEMS and not b.heading
            if led:
                yield i
            continue
        led = True
        if b.headed and not b.heading and not SENTENCE.search(b.text):
            continue
        if not b.heading and (b.tag in TEXT_TAGS or SENTENCE.search(b.text)):
            yield i


def content(blocks: list[Block], near_mean: float = NEAR_MEAN, reach: int = 3) -> list[int]:
    """Indices of the content blocks: those of paths with a score of ``near_mean`` below the page's mean at the least.

    The mean weighs paths by their text without links and by what the markup declares. A path of nothing but links is
    no content. Headings of chosen blocks, and lists that go on from them, are content as well.
    """
    if not blocks:
        return []
    sums: dict[int, _Sums] = {}
    for b in blocks:
        own = sums.setdefault(b.path, _Sums())
        own.blocks += 1
        own.chars += len(b.text)
        own.squares += len(b.text) ** 2
        own.marks += len(PUNCTUATION.findall(b.text))
        own.links += b.links
        own.declared += REGION_GAIN * any(b.regions) - ASIDE_LOSS * b.aside
    ratio = {p: path_ratio(own) for p, own in sums.items()}
    for at, b in enumerate(blocks):
        near, over = ratio[b.path], 1.0
        for step in (-1, 1):
            agree, k = b.depth, at
            while 0 <= k + step < len(blocks) and abs(k + step - at) <= reach:
                agree = min(agree, blocks[max(k, k + step)].shared)
                k += step
                other = blocks[k]
                levels = max(b.depth - b.base, other.depth - other.base, 1)
                likeness = 1.0 if other.path == b.path else max(0, agree - b.base) / levels
                w = exp(-((k - at) ** 2) / 2) * likeness
                near, over = near + w * ratio[other.path], over + w
        sums[b.path].smooth += near / over
    score, weight = {}, {}
    for p, own in sums.items():
        declared = own.declared / own.blocks
        score[p] = own.smooth / own.blocks + declared
        weight[p] = (own.chars - own.links) * exp(declared)
    if not any(weight.values()):
        return []
    bound = sum(score[p] * weight[p] for p in sums) / sum(weight.values()) - near_mean
    chosen = {p for p, own in sums.items() if score[p] >= bound and own.links < own.chars}
    kept = {i for i, b in enumerate(blocks) if b.path in chosen}
    # Lists, tables and quotations that go on from the text, at its level or below.
    level, agree, aside = None, 0, False
    for i, b in enumerate(blocks):
        agree = min(agree, b.shared)
        if b.path in chosen:
            level, agree, aside = b.depth - 1, b.depth, b.aside
        elif level is not None and b.aside <= aside and b.depth > level >= b.outer and agree >= level and 2 * b.links < len(b.text):
            kept.add(i)
        else:
            level = None
    tree = _Tree([b.open for b in blocks])
    inside = region(blocks, tree, kept)
    comments = comments_of(blocks, tree, inside, kept)
    kept |= {i for i in _text_of_region(blocks, inside) if i not in comments}
    kept -= comments
    # A heading stands over the block that follows, or over one soon after it in the same element or that around its header.
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.heading:
            agree = b.depth
            for j in range(i + 1, min(i + 1 + reach, len(blocks))):
                agree = min(agree, blocks[j].shared)
                if j in kept and b.aside <= blocks[j].aside and (j == i + 1 or agree >= b.depth - b.heading):
                    kept.add(i)
                    break
    return sorted(kept)


def main_text(html: str | None) -> str:
    """The content blocks of a page, two line breaks apart; empty for null, empty or textless pages."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n\n".join(blocks[i].text for i in content(blocks))


def extract_text(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``df``, from its whole html.

    A null html counts as empty and gives an empty text; null ids and urls stay null; repeated rows stay;
    extra columns are left out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
