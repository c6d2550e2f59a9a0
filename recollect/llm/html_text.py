"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. Text that markup itself sets apart from the article (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments: by element, role or class name) leaves ``WINDOW`` empty lines
in its place. A line's length is that of its text without link texts. Sums over sliding windows of lines surge where text
begins and dive to nothing where it ends; what lies between a surge and the next dive is a region, and a region ends with
its last line that has text of its own. So rows of links around a text, or ``WINDOW`` of them within it, are no part of it.

On pages that mark their article (article, main or role=main) regions are those of its lines, any text there makes a surge, and
a block that is one link counts as text: lists of reading belong to an article. Rows of several links do not. On other pages a surge
needs ``SURGE`` characters in a window (or what the page's largest window has, if less), and all such regions are kept.

A class name (or the id of an element that is no heading or paragraph) sets a block apart if it is a word of ``NAMES``, or joins
such words with words of ``PLACES`` (comment-list, site-footer); other compounds (share-price, related-work) are the text's own
and do not. A block set apart by name is kept all the same where it holds most of an unmarked page's text. Words of
buttons and labels within a line are part of it; blocks of nothing else are not.

Defined cases: null and empty pages, and pages without text, give an empty text; a page of nothing but links has none; markup
may be cut off anywhere; character references are decoded once; very long pages are read whole; rows are kept one to one;
other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import arrow_rows, emit

WINDOW, SURGE = 3, 20
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_LETTER = re.compile(r"\w")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title head".split())
#: Raw elements whose content the tokens must skip as text, as it may hold markup.
_ENDS = {t: re.compile(rf"</{t}[\s/>]|</{t}\Z", re.I) for t in "script style textarea title noscript template iframe svg select".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements beside the article.
BESIDE = frozenset("nav footer aside form dialog menu fieldset".split())
#: Elements inside a line whose words are controls of the page where they stand alone.
CONTROLS = frozenset("button label".split())
INLINE = frozenset("button label a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids beside the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar aside widget widgets related recommended recommendations share sharing social nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager masthead topbar footer copyright comment comments disqus respond replies reply login search skip toolbar paywall disclaimer".split()
)
#: Words that compounds with ``NAMES`` are made of.
PLACES = frozenset(
    "site page main global top bottom left right primary secondary header head bar box block area wrap wrapper container inner outer content section list item items "
    "row column col group panel pane module unit slot zone link links post posts article articles story stories icon icons button buttons form field input title heading "
    "body text small large mobile desktop sticky fixed js is has".split()
)
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
MAIN_ROLES = frozenset(["main", "article"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class _Open:
    tag: str
    beside: int  # 0: text counts, 1: set apart by element or comments, 2: by other names, which an article inside overrules
    article: bool
    link: bool
    control: bool = False
    by: int = -1  # the place of the tag whose name sets this apart


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}


def _names(attributes: dict[str, str], tag: str) -> set[str]:
    """Words of the class names and the id that say what an element is for: those of ``NAMES``, and header, in compounds of such words."""
    value = attributes.get("class", "")
    if "id" in attributes and tag != "p" and tag not in HEADINGS:
        value = f"{value} {attributes['id']}"
    found: set[str] = set()
    for name in value.split():
        words = set(_NAME.findall(_CAMEL.sub(r"\1 \2", name).lower()))
        if words <= NAMES | PLACES:
            found |= words & (NAMES | {"header"})
    return found


def lines_of(page: str, overruled: frozenset[int] = frozenset()) -> tuple[list[str], np.ndarray, np.ndarray, Counter]:
    """Lines of the stripped page (empty where something was set apart), lengths without links, and which are in an article.

    Last, by the place of each tag set apart for its name, the text without links that went with it; in ``overruled`` are
    such places at which names count for nothing.
    """
    lines: list[str] = []
    lengths: list[int] = []
    marked: list[bool] = []
    stack: list[_Open] = [_Open("", 0, False, False)]
    parts: list[str] = []
    linked, own, links, control = 0, False, 0, False
    seen_article = False
    apart: Counter = Counter()

    def flush() -> None:
        nonlocal linked, own, links, control
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text and (own or links or not control):
            lines.append(text)
            one_link = links == 1 and not own and stack[-1].article
            lengths.append(len(text) if one_link else max(1, len(text) - linked) if own else 0)
            marked.append(stack[-1].article)
        parts.clear()
        linked, own, links, control = 0, False, 0, False

    def gap() -> None:
        lines.extend([""] * WINDOW)
        lengths.extend([0] * WINDOW)
        marked.extend([False] * WINDOW)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        place, at = at, m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            top = stack[-1]
            if not top.beside and (s[0] != "<" or s == "<"):
                parts.append(s)
                if top.link or top.control:
                    linked += len(s.strip())
                    control |= top.control
                elif not own:
                    own = _LETTER.search(html_lib.unescape(s) if "&" in s else s) is not None
            elif top.beside == 2 and not top.link and s[0] != "<":
                apart[top.by] += len(s.strip())
            elif not top.beside and s.startswith("<![CDATA["):
                parts.append(html_lib.escape(s[9:].removesuffix("]]>")))
                own = own or _LETTER.search(s, 9) is not None
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if stack[k].beside and not stack[k - 1].beside:
                        flush()
                        gap()
                    elif stack[k].article != stack[k - 1].article:
                        flush()
                    del stack[k:]
                    break
            continue
        if tag not in INLINE and tag not in RAW:
            flush()
            if stack[-1].tag == "p" and tag in ("p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "aside", "nav", "form", "header", "blockquote", "pre") and len(stack) > 1:
                stack.pop()
            elif tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack[-1].tag == tag:
                stack.pop()
        elif tag == "br":
            parts.append(" ")
        if tag in RAW:
            if tag in _ENDS:
                close = _ENDS[tag].search(page, at)
                at = close.start() if close else end
                m = _TOKEN.match(page, at) if close else None
                at = m.end() if m else end
            elif tag not in VOID and not m[0].endswith("/>"):
                stack.append(_Open(tag, 1, False, False))
            continue
        if tag in VOID or m[3].endswith("/") and tag in INLINE:
            continue
        top, attributes = stack[-1], _attributes(m[3])
        role, names = attributes.get("role", "").lower(), _names(attributes, tag)
        article = tag in ("article", "main") or role in MAIN_ROLES
        beside = top.beside
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
            beside = beside or 1
        if article and names & COMMENTS:
            article, beside = False, 1
        if article and beside == 2 and not seen_article:
            beside = 0
        by = top.by
        if not beside and not article and tag not in ("html", "body"):
            if tag in BESIDE or role in ROLES or names & COMMENTS:
                beside = 1
            elif tag == "header" and not top.article:
                beside, by = 2, place
            elif (names & NAMES or "header" in names and not top.article and tag not in HEADINGS) and place not in overruled:
                beside, by = 2, place
        seen_article |= article and not beside
        if beside and not top.beside:
            flush()
            gap()
        elif article and not top.article:
            flush()
        links += tag == "a" and not beside
        stack.append(_Open(tag, beside, (top.article or article) and not beside, top.link or tag == "a", top.control or tag in CONTROLS, by))
    flush()
    return lines, np.array(lengths, np.int64), np.array(marked, bool), apart


def regions(lengths: np.ndarray, surge: float) -> list[tuple[int, int]]:
    """Lines between surges and dives: a window of ``WINDOW`` lines from the line on reaches ``surge`` characters, and later
    one has none. A region begins with the window's first line that has text of its own and ends with the last that has."""
    if not len(lengths):
        return []
    total = np.concatenate([[0], np.cumsum(lengths), np.full(WINDOW, lengths.sum())])
    block = total[WINDOW : WINDOW + len(lengths)] - total[: len(lengths)]
    out, begin, last = [], None, 0
    for i, n in enumerate(block):
        if lengths[i]:
            last = i
            if begin is None and n >= surge:
                begin = i
        if begin is not None and not n:
            out.append((begin, last + 1))
            begin = None
    if begin is not None:
        out.append((begin, last + 1))
    return out


def main_text(page: str | None) -> str:
    """Blocks of the article, in order, one to a line."""
    if not page:
        return ""
    overruled: frozenset[int] = frozenset()
    while True:
        lines, lengths, marked, apart = lines_of(page, overruled)
        if marked.any() or not apart:
            break
        place, most = max(apart.items(), key=lambda x: (x[1], -x[0]))
        if 2 * most <= lengths.sum() + apart.total() or place in overruled:
            break
        overruled |= {place}
    if marked.any():
        lengths, surge = np.where(marked, lengths, 0), 1
    else:
        surge = max(1, min(SURGE, np.convolve(lengths, np.ones(WINDOW, np.int64)).max(initial=0)))
    inside = marked if marked.any() else np.ones(len(lines), bool)
    return "\n".join(x for a, b in regions(lengths, surge) for x, own in zip(lines[a:b], inside[a:b]) if own and x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((i, u, t, len(t)) for i, u, h in arrow_rows(batches, ["page_id", "url", "html"]) for t in (main_text(h),)), schema, 512)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
