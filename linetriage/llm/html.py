"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3  # lines whose text lengths are summed
LEAST = 120  # characters in a window at which text outside of a main part surges
SHARE = 0.2  # of the largest window outside of main parts that a stretch must reach

_RAW = frozenset("script style noscript template textarea iframe svg title select object canvas".split())
_OPEN = re.compile(r"<(?:(?P<end>/?)(?P<tag>[a-z][^\s/>]*)|!--|[!?])", re.IGNORECASE)
# What may stand before the end of a tag: quotes enclose a value only behind an equals sign.
_MORE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
_QUOTED = re.compile(r"=\s*([\"'])")


class _Tokens:
    """Tags of a page (start, end, tag or None, whether it ends an element, attributes), in one movement forward.

    What looks like a tag but does not end is text. Whether an end still follows is asked once: an end mark
    that is not found from one place on is not looked for again, so broken pages take linear time.
    """

    def __init__(self, page: str):
        self.page, self.lower = page, page.lower()
        self.plain = len(self.lower) == len(page)
        self.next_at: dict[str, int] = {}
        self.quotes = True

    def find(self, mark: str, at: int) -> int:
        """Place of the next ``mark`` from ``at`` on, or -1; remembered until it is passed."""
        known = self.next_at.get(mark, 0)
        if known >= 0 and known < at or mark not in self.next_at:
            known = self.next_at[mark] = (self.lower if self.plain else self.page).find(mark, at)
        return known

    def after_raw(self, tag: str, at: int) -> int:
        """Where the element that starts before ``at`` and holds no markup ends."""
        mark = f"</{tag}"
        while (found := self.find(mark, at)) >= 0:
            stop = found + len(mark)
            closed = self.find(">", stop)
            if closed < 0:
                break
            if not self.page[stop:closed].strip():
                return closed + 1
            at = stop
        return len(self.page)

    def tag_end(self, at: int) -> int:
        """Where the attributes that start at ``at`` end: at the first > outside of quoted values.

        Where a quoted value or the tag behind it has no end, tags of the rest of the page end at their first >.
        """
        first = self.find(">", at)
        stop = at
        while first >= 0 and self.quotes:
            stop = _MORE.match(self.page, stop, first).end()
            if stop == first:
                break
            opened = _QUOTED.match(self.page, stop)
            close = self.find(opened[1], opened.end()) if opened else -1
            stop = close + 1
            first = self.find(">", stop) if close >= 0 else -1
            if first < 0:
                self.quotes = False
                self.next_at.pop(">")
                return self.find(">", at)
        return first

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        page, at = self.page, 0
        while (opened := _OPEN.search(page, at)) is not None:
            start, tag = opened.start(), opened["tag"]
            if tag is None:
                mark = "-->" if opened[0] == "<!--" else ">"
                end = self.find(mark, opened.end())
                if end < 0 and mark == ">":
                    at = opened.end()
                    continue
                at = len(page) if end < 0 else end + len(mark)
                yield start, at, None, False, ""
                continue
            end = self.tag_end(opened.end())
            if end < 0:
                return  # no > is left, so no tag either: the rest is text
            at, tag = end + 1, tag.lower()
            if tag in _RAW and not opened["end"]:
                at = self.after_raw(tag, at)
                yield start, at, None, False, ""
            else:
                yield start, at, tag, bool(opened["end"]), page[opened.end() : end]


_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ASIDE = frozenset("head nav header footer aside form menu dialog button fieldset".split())
_MAIN = frozenset(("article", "main"))
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
_NAMED = re.compile(r"(?<![\w-])(?P<name>class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsbygoogle|banner|promo|promotion|sponsor(?:ed)?|nav|navbar|navigation|menu|"
    r"sidebar|side|footer|header|masthead|comments?|comment-list|respond|replies|reply|disqus|cookies?|notice|consent|gdpr|"
    r"alert|popup|modal|overlay|share|sharing|social|related|recommended|breadcrumbs?|newsletter|subscribe|subscription|login|"
    r"signup|search|widget|pagination|pager|toolbar|contentinfo|complementary|dialog|hidden)(?:$|[\s_-])", re.IGNORECASE)
#: Class words that say the same wherever they stand; "related", "search", "side" or "header" alone do not.
_CLEAR = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsbygoogle)(?:[-_]?(?:slot|unit|box|container|wrapper|banner|block|area|label|\d+))*"
    r"|(?:(?:reader|user|page|post|article)[-_]?)?comments?(?:[-_]?(?:list|area|section|container|wrapper|thread|form|body|text|item))?"
    r"|disqus(?:[-_]thread)?"
    r"|share|sharing|sharedaddy|(?:social[-_]?)?(?:share|sharing)[-_]?(?:bar|buttons?|links?|icons?|tools?)?|social[-_]share"
    r"|(?:(?:left|right|page|site|main)[-_]?)?side[-_]?bar(?:[-_]?(?:left|right|\d+))?"
    r"|(?:cookies?|consent|gdpr)(?:[-_]?(?:banner|notice|bar|box|message|popup|consent|law|policy))*"
    r"|notices?|notice[-_]?(?:bar|box)|site[-_]notice"
    r"|newsletter(?:[-_]?(?:signup|sign-up|form|box|subscribe))?"
    r"|breadcrumbs?|(?:(?:main|top|site|page|nav)[-_]?)?menu|related[-_]?(?:posts?|articles?|stories|links?|content)",
    re.IGNORECASE)
_ROLES = frozenset("navigation complementary contentinfo dialog alertdialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|\s)(?:aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none)", re.IGNORECASE)


def _set_aside(tag: str, more: str, in_main: bool) -> bool:
    """Whether markup says that an element is not article text; inside a main part only names that are clear count."""
    if tag in _ASIDE and not (tag == "header" and in_main):
        return True
    if not more or tag in ("body", "html", "article", "main"):
        return False
    if _UNSEEN.search(more) or _HIDDEN.search(_VALUE.sub("=", more)):
        return True
    named = [(m["name"].lower(), next(filter(None, m.groups()[1:]), "")) for m in _NAMED.finditer(more)]
    if not in_main:
        return tag not in _HEADINGS and any(_WORDS.search(value) for _, value in named)
    for name, value in named:
        if name == "role" and value.lower() in _ROLES:
            return True
        if tag not in _HEADINGS and (name == "class" or name == "id" and tag != "section"):
            if any(_CLEAR.fullmatch(word) for word in value.split()):
                return True
    return False


def lines(page: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The page's lines of text (one per block), the length each counts with, and the number of its main part.

    Text counts unless its element is set aside by markup; link text counts only inside a main part.
    Main parts (outermost article or main elements) are numbered from 1; other lines have 0.
    """
    out: list[str] = []
    aside_of: list[bool] = []
    part_of: list[int] = []
    linked: list[int] = []
    parts: list[str] = []
    main = main_parts = links = in_link = 0
    skip, depth = "", 0

    def close() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(text)
            aside_of.append(bool(skip))
            part_of.append(main_parts if main else 0)
            linked.append(links)
        parts, links = [], 0

    at = 0
    for start, after, tag, ending, more in _Tokens(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                links += len(piece)
        at = after
        if tag is None:
            continue
        if tag == "a":
            in_link = 0 if ending else 1
        if tag not in _INLINE:
            close()
            if skip in _CLOSED_BY_NEXT and (tag == skip and not ending or ending and tag != skip):
                skip = ""
        if tag in _VOID:
            continue
        if skip:
            if tag == skip:
                depth += -1 if ending else 1
                if not depth:
                    close()
                    skip = ""
        elif not ending and _set_aside(tag, more, main > 0):
            close()
            skip, depth = tag, 1
        if tag in _MAIN and not skip:
            main_parts += not main and not ending
            main = max(0, main + (-1 if ending else 1))
    parts.append(page[at:])
    close()
    counted = [0 if a else len(t) if p else max(0, len(t) - k) for t, a, p, k in zip(out, aside_of, part_of, linked)]
    return out, np.array(counted, np.int64), np.array(part_of, np.int64)


def stretches(counted: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Line ranges from where text may surge to the next dive, each with its largest block.

    The block at a line is the sum over ``window`` lines from it. A range starts at a counting line and
    dives before the first run of ``window`` lines that count nothing.
    """
    padded = np.concatenate([counted, np.zeros(window, np.int64)])
    blocks = np.convolve(padded, np.ones(window, np.int64))[window - 1 :][: len(counted)]
    found, at = [], 0
    while at < len(counted):
        if not counted[at]:
            at += 1
            continue
        end = at
        while end < len(counted) and blocks[end]:
            end += 1
        found.append((at, end, int(blocks[at:end].max())))
        at = end
    return found


def main_text(page: str, window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> str:
    """The article of a page, one block a line; empty if there is none.

    Main parts bound stretches, and what is set aside inside of one makes no dive. Text outside surges at
    ``least`` characters in a window, ``share`` of the largest window outside and no less than the largest
    window of a main part. Main parts surge at any length or, beside such text, at ``share`` of its largest
    window.
    """
    text, counted, part = lines(page)
    at = np.flatnonzero((counted > 0) | (part == 0))
    found = [
        (piece[a:b], peak, part[piece[0]] > 0)
        for piece in np.split(at, np.flatnonzero(np.diff(part[at])) + 1) if len(piece)
        for a, b, peak in stretches(counted[piece], window)
    ]
    outside = max((peak for _, peak, marked in found if not marked), default=0)
    inside = max((peak for _, peak, marked in found if marked), default=0)
    surge = max(least, int(share * outside), inside)
    beside = share * outside if outside >= surge else 1
    return "\n".join(
        text[i] for piece, peak, marked in found if peak >= (beside if marked else surge) for i in piece if counted[i])


def extract(pages: DataFrame, window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Text lengths over windows of lines decide on every page, see ``main_text``. Null and empty pages, and
    pages without article text, have an empty text. Every row gives one row, whatever its id or url; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                text = [main_text(h or "", window, least, share) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
