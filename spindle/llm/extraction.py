"""Main text of web pages (operator 5).

Two-pass block rules. A page is cut into blocks at block-level tags. The first pass decides a
block by where it stands (menus, headers, footers, forms, adverts, comments and the like are
never main text), by the share of its characters inside links, and by its length and share of
stop words; short blocks that these leave open are ambiguous. In the second pass an ambiguous
block takes the label of its nearest decided neighbours.

Pages are independent: one map over Arrow batches, no shuffle, memory for one block of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Function words of the languages that the tables hold.
STOP_WORDS = frozenset("""
the of and to in a is that for it was on are as with be at by this from or an not have his her they which
der die das und in zu den mit von ist auf für im dem ein eine nicht sich des auch als an es
le la les de des du et un une en que qui dans pour par sur au avec est pas ce il elle sont ou
el los las del y en un una que por con para es se no su al lo como más o
""".split())

#: Elements whose content is not text.
RAW = frozenset("script style title textarea noscript template iframe svg math object select canvas audio video".split())
#: Elements that are never main text.
ASIDE = frozenset("nav footer aside form button dialog menu fieldset label option".split())
#: Elements that hold the main text where a page has them.
MAIN = frozenset(("article", "main"))
#: Elements that begin and end a block.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label option""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These end an open element of the same group, as their end tags may be left out.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SAME_WITHIN = frozenset("ul ol dl table tbody thead tfoot menu div section article main body select".split())

#: Words in class, id or role that mark what is not main text.
CUES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe signup login sidebar sidenav aside widget menu nav navbar navigation
breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended comment comments respond reply replies
disqus discussion search pagination pager copyright disclaimer contentinfo complementary dialog skip""".split())
COMMENT_CUES = frozenset("comment comments reply replies respond disqus discussion".split())

SHORT, LONG, FEW_STOPS, MANY_STOPS, LINKED = 70, 200, 0.05, 0.15, 0.5

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

GOOD, BAD, OPEN = 1, -1, 0


class _Block:
    __slots__ = ("text", "linked", "bad", "main", "heading", "home", "depth", "lead")

    def __init__(self, bad: bool, main: bool, heading: bool, home: int, depth: int = 0, lead: bool = False):
        self.text: list[str] = []
        self.linked = 0
        self.bad, self.main, self.heading, self.home, self.depth, self.lead = bad, main, heading, home, depth, lead


def _cues(attrs: str) -> tuple[set[str], bool, str]:
    """Words of class and id, whether the element is hidden, its role."""
    words: set[str] = set()
    hidden, role = False, ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words.update(w.lower() for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w)
        elif name == "role":
            role = value.lower()
            words.update(_SPLIT.split(role))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return words, hidden, role


def cut(page: str) -> list[_Block]:
    """Blocks of a page in order, each with where it stands."""
    out: list[_Block] = []
    # tag, bad, main, in a header (1: of the page, 2: of the article), heading, number of the element that holds its blocks, then what an article inside is not
    # bad for: number of elements around that are bad by class or id alone, in a header by class or id alone, number of both above the article
    stack: list[tuple[str, bool, bool, int, bool, int, int, bool, int]] = [("", False, False, 0, False, 0, 0, False, 0)]
    homes = 0
    block = _Block(False, False, False, 0)
    links = 0
    at, end = 0, len(page)

    def fresh() -> None:
        nonlocal block
        if block.text:
            out.append(block)
        _, bad, main, header, heading, home, named, headed, depth = stack[-1]
        block = _Block(bad or named > 0 or ((header == 1 or headed) and not (main and heading)), main, heading, home, depth, header == 2 and not heading)

    def text(part: str) -> None:
        if part:
            block.text.append(part)
            if links:
                block.linked += len(part)

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = m[1], m[2], m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    fresh()
                    break
            else:
                if tag in BLOCK:
                    fresh()
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                fresh()
            continue
        words, hidden, role = _cues(attrs) if attrs and not attrs.isspace() else (set(), False, "")
        if tag in ("html", "body"):
            fresh()
            continue
        if tag == "a":
            links += 1
        is_main = tag in MAIN or role == "main"
        firm = hidden or tag in ASIDE or bool(words & COMMENT_CUES) or not is_main and bool(CUES.intersection(_SPLIT.split(role)))
        cue = firm or not is_main and bool(words & CUES)
        if tag in BLOCK or cue:
            if tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
                if tag in SAME:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in SAME[tag]:
                            del stack[i:]
                            break
                        if stack[i][0] in SAME_WITHIN:
                            break
                links = 0 if tag != "a" else links
            _, bad, main, header, heading, home, named, headed, depth = stack[-1]
            if is_main:  # what holds an article is not known by its class or id
                depth, named, headed = depth + named + headed, 0, False
            header = header or (tag == "header") * (2 if main else 1)
            headed = headed or "header" in words and not is_main
            named += cue and not firm
            if tag != "p" and tag not in HEADINGS:
                homes += 1
                home = homes
            stack.append((tag, bad or firm, main or is_main and not cue, header, heading or tag in HEADINGS, home, named, headed, depth))
            fresh()
    if at < end:
        text(page[at:])
    if block.text:
        out.append(block)
    return out


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: _Block, text: str, has_main: bool, known: bool = True) -> int:
    """GOOD, BAD or OPEN (ambiguous). known: stop words can speak, as the page's language has them."""
    if has_main and not block.main:
        return BAD
    if block.linked > LINKED * max(1, sum(map(len, block.text))):
        return OPEN if block.main else BAD
    stops = _stops(text)
    if block.heading or len(text) < SHORT:
        return OPEN
    if stops >= MANY_STOPS:
        return GOOD
    if block.main:  # inside the article, text is kept however it reads
        return GOOD if len(text) >= LONG or stops >= FEW_STOPS else OPEN
    if not known:  # length speaks alone
        return GOOD
    return OPEN if stops >= FEW_STOPS else BAD


def second_pass(labels: list[int], main: list[bool], home: list[int]) -> list[bool]:
    """Whether each block is kept: an open one takes the label of its nearest decided neighbour.

    Neighbours count within the article only, where there is one; of two equally near ones that
    differ, the one in the same element counts; where neither or both are, or there is none,
    an open block stays in the article and goes elsewhere.
    """
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, to, step in ((range(n), before, 1), (range(n - 1, -1, -1), after, -1)):
        last = None
        for i in order:
            if labels[i] != OPEN:
                last = i
            to[i] = last
    kept = []
    for i, label in enumerate(labels):
        if label != OPEN:
            kept.append(label == GOOD)
            continue
        near = sorted((abs(i - j), home[j] != home[i], labels[j]) for j in (before[i], after[i]) if j is not None and main[j] == main[i])
        if not near or len(near) == 2 and near[0][:2] == near[1][:2] and near[0][2] != near[1][2]:
            kept.append(main[i])
        else:
            kept.append(near[0][2] == GOOD)
    return kept


def main_text(page: str | None) -> str:
    """The article of one page; empty where there is none."""
    if not page:
        return ""
    blocks = [(b, t) for b in cut(page) if (t := _clean(b.text))]
    has_main = any(b.main and not b.bad for b, _ in blocks)
    # of several articles, those under the fewest wrappers named like what is no text; headings alone are no article
    depth = min((b.depth for b, _ in blocks if b.main and not b.bad and not b.heading), default=0)
    blocks = [(b, t) for b, t in blocks if not b.bad and not (b.main and b.depth > depth)]  # others stand where no text does, so they are no one's neighbours
    # in the article's own header, what reads like a paragraph is its lead; names, dates and the like are not
    blocks = [(b, t) for b, t in blocks if not b.lead or first_pass(b, t, has_main) == GOOD]
    known = has_main or _stops(" ".join(t for _, t in blocks)) >= FEW_STOPS
    labels = [first_pass(b, t, has_main, known) for b, t in blocks]
    kept = second_pass(labels, [b.main for b, _ in blocks], [b.home for b, _ in blocks])
    return " ".join(t for (_, t), keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page gives an empty text; page_id and url are passed on as they are, null or
    repeated; an empty table gives no rows. Other columns are not read. A page that is cut off
    in the middle of a tag or reference loses no more than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sources in common.blocks(batch.column(2)):
                texts = [main_text(s) for s in sources]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.take(pages, page_id="long", url="string", html="string").mapInArrow(run, SCHEMA)
