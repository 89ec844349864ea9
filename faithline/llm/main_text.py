"""Main text of web pages by the distribution of text over line blocks.

A page's markup is stripped in one pass: comments, scripts, styles and other elements that hold no prose go, character references are decoded, and
every block element starts a new line. Each line has a length, its characters outside links; lines inside elements that are furniture
by name, role or class (menus, page headers, footers, sidebars, notices, adverts, forms, comments) have none. Lengths are
summed over sliding windows of WINDOW lines. Where the sums rise from zero the text surges, where they fall back to zero it
dives; every stretch between a surge and a dive that weighs enough beside the heaviest one is kept, with all its lines that are not furniture.
Furniture inside an <article> or <main> makes no dive, and the borders of such an element always do.

A task goes over its pages one by one, each page once from start to end, so time and memory are proportional to the page; nothing is shuffled.

Defined results: a null or empty page, or one without text, has an empty text and no characters; malformed and cut-off pages are read as
browsers do (an unclosed tag or comment takes the rest, a container's end closes what is open inside it); a page of furniture alone, by its
class names or in one form, is gone over again without regard to these; very long pages are read whole; every row gives one row, null ids and
repeated rows too; other columns are ignored."""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import table

#: Lines of a window, and the share of the heaviest window that another stretch's heaviest window has to reach.
WINDOW, SHARE = 3, 1 / 3

# Element names of HTML, and words by which page furniture is named.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
SIBLINGS = frozenset("dd dt li option p td th tr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
FURNITURE = frozenset("head nav footer aside form button select option datalist dialog menu noscript template svg canvas object audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer form gdpr header login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommendations recommended related replies reply respond share sharing sidebar sidebars signup social sponsor "
    "sponsored subscribe subscription toolbar topbar widget widgets".split())
PROSE = frozenset("article body content entry main page post story text".split())
WITH = frozenset("has no with without".split())

_TAG = re.compile(
    r"<!--(?:>|->|(?:.*?)(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])(?:([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++))|(hidden)(?![^\s/]))")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}
_WORD_BORDER = re.compile(r"(?<=[a-z])(?=[A-Z])")


def named_furniture(names: str) -> bool:
    """Does a class or id say that an element is no part of the text? Its last word decides, or any where none speaks of prose."""
    for name in names.split():
        words = re.findall(r"[a-z]+", _WORD_BORDER.sub("-", name).lower())
        if words and words[0] not in WITH and (words[-1] in WORDS or (not WORDS.isdisjoint(words) and PROSE.isdisjoint(words))):
            return True
    return False


def is_furniture(name: str, attributes: str, in_text: bool, strict: bool) -> bool:
    """Is an element page furniture, by its name, or by its role, class or id?"""
    if name in ("html", "body", "main"):
        return False
    if (name in FURNITURE and (strict or name != "form")) or (name == "header" and not in_text):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values, bare in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), _html.unescape("".join(values))
        if bare or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES) or (strict and key in ("class", "id") and named_furniture(value)):
            return True
    return False


class Page:
    """The lines of a page: (text, length) of each block in order. Furniture is a line without text and length; a length
    below zero is the border of the outermost text element."""

    def __init__(self, page: str, strict: bool = True):
        self.lines: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool]] = []  # elements that are open, and which are furniture
        self.names: Counter = Counter()
        self.held: list[str] = []
        self.linked = self.hidden = self.within = 0
        in_link, at = False, 0
        while (m := _TAG.search(page, at)) is not None:
            self.text(page[at : m.start()], in_link)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if name in ("br", "td", "th"):
                self.held.append(" ")
            elif name not in INLINE:
                self.flush()
                in_link = False
            if m[1]:
                in_link = in_link and name != "a"
                if self.names[name]:
                    self.close(name)
                continue
            in_link = in_link or name == "a"
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            elif name not in VOID:
                self.start(name, m[3], strict)
        self.text(page[at:], in_link)
        self.flush()

    def text(self, part: str, in_link: bool) -> None:
        if part:
            self.held.append(part)
            if in_link:
                self.linked += len(_html.unescape(part).strip())

    def flush(self) -> None:
        """End a line."""
        text = " ".join(_html.unescape("".join(self.held)).split())
        if text and not self.hidden:
            self.lines.append((text, max(0, len(text) - self.linked)))
        elif text and not self.within:
            self.lines.append(("", 0))
        self.held.clear()
        self.linked = 0

    def start(self, name: str, attributes: str, strict: bool) -> None:
        if self.names["head"] and name not in HEAD and name != "head":
            self.close("head")
        if name == "main" or (name == "article" and self.names["nav"]):
            while self.hidden:  # it can't stand in what is open: that was never closed
                self.close(self.open[-1][0])
        last = self.open[-1][0] if self.open else ""
        if (last == name and name in SIBLINGS) or (last == "p" and name not in INLINE):
            self.close(last)
        gone = is_furniture(name, attributes, bool(self.within), strict)
        if not (gone or self.hidden or name not in INLINE):
            return
        if gone:
            self.flush()
        if name in ("article", "main"):
            self.border(+1)
        self.open.append((name, gone))
        self.names[name] += 1
        self.hidden += gone

    def close(self, name: str) -> None:
        """Close what is open down to the innermost element of a name."""
        self.flush()
        while True:
            last, gone = self.open.pop()
            self.names[last] -= 1
            self.hidden -= gone
            if last in ("article", "main"):
                self.border(-1)
            if last == name:
                return

    def border(self, step: int) -> None:
        if min(self.within, self.within + step) == 0:
            self.lines.append(("", -1))
        self.within += step


def stretches(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, weight): the first and last line with a length of each stretch over which the windows' sums stay above zero, and its heaviest window."""
    out: list[tuple[int, int, int]] = []
    start, before = 0, 0
    for i, length in enumerate(lengths):
        if length < 0:
            start, before = i + 1, 0
            continue
        total = sum(lengths[max(start, i - WINDOW + 1) : i + 1])
        if total and not before:
            out.append((i, i, total))
        elif total:
            surge, dive, weight = out[-1]
            out[-1] = (surge, i if length else dive, max(weight, total))
        before = total
    return out


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block."""
    for strict in (True, False):
        lines = Page(page or "", strict).lines
        found = stretches([length for _, length in lines])
        if found:
            least = SHARE * max(weight for _, _, weight in found)
            return "\n".join(text for surge, dive, weight in found if weight >= least for text, _ in lines[surge : dive + 1] if text)
    return ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=[id_col, url_col, "text", "n_chars"])

    d = pages.select(f"`{id_col}`", f"`{url_col}`", f"`{html_col}`")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[:2]]
    return d.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
