"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block tags. The first pass classifies each block by the place it stands in, its link
density, its length and the density of stop words: `bad` (menus, headers, footers, forms, adverts, comments, blocks of
links), `good` (long enough with stop words), or undecided: `near` (long, fewer stop words) and `short`. The second
pass gives undecided blocks the label of their nearest decided neighbours: good if either neighbour is good, within the
article if the page has one, else as its nearest; without a decided neighbour, `near` blocks are good.

The text is the good blocks in page order, one on a line; references are decoded, white space within a block is one
blank. Null and empty pages have the empty text. A page that is cut off, or has unclosed tags, is read as far as it goes.
An article is preferred only if articles hold the larger part of the long text; where they hold the smaller one they are
teasers, and what is around them is the text. Reader comments go by their names, in articles of their own too.

Pages are independent: repeated rows give repeated results, ties don't occur, and an empty table gives an empty result.
A very long page is whole, in a task by itself. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import in_groups

#: Limits of the first pass: characters of a short and a long block, stop-word densities, link density.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.10, 0.20, 0.33
GROUP = 8 << 20

#: Frequent words of four languages.
STOP_WORDS = {
    "en": "a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she so that the their there they this to was we were what when which who will with would you",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous",
    "es": "a al como con de del el ella en entre era es esta este ha hay la las lo los más me no nos o para pero por porque que se ser si sin sobre son su sus te un una y ya",
}
ALL_STOP_WORDS = frozenset(" ".join(STOP_WORDS.values()).split())
#: Tags.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED_TAGS = frozenset("nav header footer aside form head title menu button select option textarea noscript template iframe object svg canvas audio video dialog fieldset label input".split())
ARTICLE_TAGS = frozenset(("article", "main"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the next block or item of the same sort.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
#: Names in class, id or role that mark what is no article; a name counts if all its parts are such words.
DROPPED_WORDS = re.compile(
    r"(?:^|\s)(?:W)(?:[_-]+(?:W))*(?:$|\s)".replace(
        "W", r"ad|ads|adv|advert\w*|banner\w*|breadcrumb\w*|comment\w*|contentinfo|cookie\w*|consent|disqus|footer\w*|header|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notice\w*|pager|pagination|popup|promo\w*|related|replies|respond|share\w*|sharing|sidebar\w*|social|sponsor\w*|subscribe|toolbar|widget\w*"
    ),
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|textarea|xmp)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<svg\b(?![^>]*/>)[^>]*+>.*?(?:</svg\s*>|\Z)"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
#: First parts of names of reader comments, and second parts with which such a name is a state instead.
COMMENTS = re.compile(r"(?:^|\s)(?:comments?|commentlist|disqus|replies|respond)(?:[_-]+(?!(?:open|closed|enabled|disabled|on|off|allowed|none)(?:\s|$))[^\s_-]+)*[_-]*(?=\s|$)", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
WORDS = re.compile(r"[^\W\d_]+")


def marks(attributes: str) -> tuple[list[str], bool]:
    """The class, id and role of a tag, and whether it is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden":
            hidden |= value.lower() not in ("false", "until-found")
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(NO_DISPLAY.search(value))
    return names, hidden


class Block(NamedTuple):
    text: str
    link_chars: int
    dropped: bool
    article: bool
    heading: bool


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page that have text, in order."""
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, article, dropped with the articles within
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    breaks = 0
    heading = False
    dropped = article = False
    position = 0

    def close() -> Block | None:
        text = " ".join(html.unescape("".join(parts)).split())
        count = len(" ".join(html.unescape("".join(links)).split()))
        parts.clear()
        links.clear()
        return Block(text, count, dropped, article, heading) if text else None

    for m in TOKEN.finditer(page):
        if m.start() > position:
            text = page[position : m.start()]
            parts.append(text)
            if in_link:
                links.append(text)
            if breaks and not text.isspace():
                breaks = 0
        position = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = bool(m[2] or m[5])
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1 and (done := close()):
                yield done
            continue
        if tag == "a":
            in_link = max(0, in_link - 1) if closing else in_link + 1
        if tag not in BLOCK_TAGS and tag not in DROPPED_TAGS:
            continue
        breaks = 0
        if done := close():
            yield done
        in_link = 0
        if tag in VOID_TAGS or tag == "svg" and not closing and (m[4] or m[7] or "").endswith("/"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[k][0] == tag:
                    open_tags.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("html", "body"):
                    break
        else:
            if stack and (stack[-1][0] == "p" or tag in OPEN_ENDED and stack[-1][0] == tag):
                open_tags[stack.pop()[0]] -= 1
            attributes = m[4] or m[7] or ""
            out, inside, hard = stack[-1][1:] if stack else (False, False, False)
            if tag in ARTICLE_TAGS and not inside:  # names of what is around it say nothing about an article
                out = hard
            if attributes and not hard and tag not in ("body", "html", "main"):
                names, hard = marks(attributes)
                hard |= any(COMMENTS.search(x) for x in names)
                out = out or hard or tag != "article" and any(DROPPED_WORDS.search(x) for x in names)
            own = tag in DROPPED_TAGS and not (tag == "header" and inside)
            stack.append((tag, out or own, (inside or tag in ARTICLE_TAGS), hard or own))
            open_tags[tag] += 1
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    if position < len(page):
        parts.append(page[position:])
    if done := close():
        yield done


def first_pass(block: Block) -> str:
    """good, bad, near, short, or low: long with few stop words."""
    if block.dropped or block.link_chars > LINKS * len(block.text) and not block.heading:
        return "bad"
    if block.text.startswith("©") and not block.article:
        return "bad"
    if len(block.text) < SHORT or block.heading:
        return "short"
    words = WORDS.findall(block.text.lower())
    density = sum(w in ALL_STOP_WORDS for w in words) / max(len(words), 1)
    if density >= STOP_HIGH or density >= STOP_LOW and len(block.text) >= LONG:
        return "good"
    return "near" if block.article or density >= STOP_LOW else "low" if len(block.text) >= LONG else "near"


def second_pass(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    labels = [first_pass(b) for b in found]
    long = [0, 0]  # characters of long text around articles and in them
    for x, b in zip(labels, found, strict=True):
        long[b.article] += len(b.text) if x in ("good", "near", "low") else 0
    has_article = long[1] >= long[0] and any(b.article and not b.dropped for b in found)
    if has_article or long[0]:  # the larger part is the text
        labels = [x if b.article == has_article else "bad" for x, b in zip(labels, found, strict=True)]
    # on a page without a good block, long ones are of a language without a list
    labels = [("bad" if "good" in labels else "good") if x == "low" else x for x in labels]
    decided = ("good", "bad")
    before: list[int | None] = []
    last = None
    for i, x in enumerate(labels):
        before.append(last)
        last = i if x in decided else last
    after: list[int | None] = [None] * len(labels)
    last = None
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in decided else last
    out = []
    for i, (x, b) in enumerate(zip(labels, found, strict=True)):
        if x in decided:
            out.append(x == "good")
            continue
        near = [k for k in (before[i], after[i]) if k is not None]
        if has_article:  # outside of the article nothing is asked; dropped parts within it decide nothing
            near = [k for k in near if b.article and found[k].article and not found[k].dropped]
            out.append(not near or any(labels[k] == "good" for k in near))
        elif not near:
            out.append(x == "near" or b.heading)
        elif b.heading:
            out.append(after[i] is not None and labels[after[i]] == "good")
        else:
            least = min(abs(k - i) for k in near)
            out.append(any(labels[k] == "good" for k in near if abs(k - i) == least))
    return out


def main_text(page: str) -> str:
    found = list(blocks(page))
    return "\n".join(b.text for b, good in zip(found, second_pass(found), strict=True) if good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Map only."""

    def run(batches):
        for rows in in_groups(batches, "html", GROUP):
            texts = [main_text(x) if x else "" for x in rows.column("html").to_pylist()]
            counts = pa.array(list(map(len, texts)), pa.int64())
            yield from pa.Table.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"]).to_batches()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
