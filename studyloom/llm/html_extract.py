"""Main-text extraction by the distribution of line blocks.

Markup is stripped into lines, one per block of text. What can't be article text (scripts,
styles, forms, navigation, page headers and footers, sidebars, notices, adverts, reader
comments, lines made of links) leaves empty lines, at least as many as a window is long. So does each
border between boxes (div, section, article, ...): lines that follow each other in one box, and are
alike in being paragraphs of it or boxes of their own, are a run; others are set apart.

For each line the text lengths of a window of ``WINDOW`` lines from there are summed. A surge
is a line whose window rises from nothing; a dive is where the window's sum falls back to
nothing. The run between a surge and its dive is dense where a window in it has ``ENOUGH`` characters, or ``1 / FALL``
of the page's median window; so one long line can't outweigh others.

The dense runs tell where the article is: in the innermost box that holds ``SHARE`` of their text.
Text in an article or main element weighs ``MARK`` times as much there, but the mark alone decides nothing, so
teasers marked as articles don't beat a longer text; articles of comments or related pages, by their
own class or what they stand in, aren't marks. In the article's box everything stays, but for short boxes among paragraphs
(unless it is a marked one). Outside it only the top heading and runs stay whose windows are half as full as the article's,
and nothing outside a marked one. Where no box but the page holds the share, dense runs and the top heading stay.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by one newline in page order. Nothing else is dropped or cut.

Cases: null or empty html gives empty text; unclosed elements end with the page, paragraphs with
the next block, unfinished tags where the next one begins; a page without any text gives an empty string; repeated rows and null ids or urls
pass through; other columns are ignored. Work is linear in the length of the page, malformed or not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import read

WINDOW, FALL, ENOUGH = 3, 6, 100
SHARE, MARK = 0.7, 3

#: Elements by their role in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "annotation"}
NEVER = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "option", "svg", "object", "dialog", "menu", "audio", "video", "canvas", "datalist", "fieldset", "label"}
MAIN = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mstyle", "mspace", "mpadded", "mphantom", "menclose", "mfenced",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Names of classes and ids of what isn't the article.
FURNITURE = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "commentlist", "comments", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "foot", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
#: Names of what holds other texts than the article, so that an article element inside isn't the page's.
OTHERS = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "commentlist", "comments", "discussion", "disqus", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "sponsor", "sponsored"}
#: Of these names whole class tokens that may be of article text too, and ids that are furniture inside an article.
DOUBTFUL = {"discussion", "disclaimer", "header", "legal", "search"}
CERTAIN_IDS = {"comments", "disqus", "respond"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: First parts of class names that tell of the page, not of the element.
STATES = {"has", "with", "no", "is", "not", "without"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}

#: Blocks of text, and those around them that are no boxes of their own.
FLOW = {"p", *HEADINGS, "li", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "td", "th", "address", "summary"}
AROUND = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "center", "html", "body"}

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
PLAIN = re.compile(r"[^>\"'<]*+")
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _is_furniture(attributes: str, name: str, in_main: bool) -> bool:
    for key, *values in NAMED.findall(attributes):
        value = "".join(values).lower()
        if key.lower() == "role":
            if value.strip() in FURNITURE_ROLES:
                return True
        elif in_main or name in HEADINGS:  # names of sections tell what they are about
            sure = CERTAIN_IDS if key.lower() == "id" else FURNITURE - DOUBTFUL
            if sure & set(value.split()) and not (key.lower() == "id" and name in HEADINGS):
                return True
        else:
            for part in map(re.compile(r"[^a-z]+").split, value.split()):
                if (part[0] in FURNITURE or part[-1] in FURNITURE) and part[0] not in STATES:
                    return True
    return bool(HIDDEN.search(attributes))


def _holds_others(attributes: str) -> bool:
    """Comments, related pages, adverts: whatever is marked inside isn't the page's article."""
    values = [v for key, *vs in NAMED.findall(attributes) if key.lower() != "role" for v in "".join(vs).lower().split()]
    parts = [re.split(r"[^a-z]+", v) for v in values]
    return any((p[0] in OTHERS or p[-1] in OTHERS) and p[0] not in STATES for p in parts) or bool(HIDDEN.search(attributes))


class _Tags:
    """Finds the ends of tags. Quotes count behind an equals sign only, and an unfinished tag ends before the next one."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, place after the tag)."""
        html = self.html
        while True:
            at = PLAIN.match(html, at).end()
            c = html[at : at + 1]
            if c == ">":
                return at, at + 1
            if not c or c == "<":
                return at, at
            stop = -1
            if c not in self.missing and html[max(0, at - 8) : at].rstrip().endswith("="):
                stop = html.find(c, at + 1)
                if stop < 0:
                    self.missing.add(c)  # sought once a page
            at = at + 1 if stop < 0 else stop + 1


@dataclass
class Line:
    text: str
    box: int  # number of the innermost box
    own: bool  # whether it is that box's own text, not a paragraph's
    title: bool
    marked: bool


class Page:
    """The stripped page: lines, None for an empty one, and the boxes' parents."""

    def __init__(self, html: str):
        self.lines: list[Line | None] = []
        self.parent, self.main = [0], [False]  # box 0 is the page
        self._read(html)

    def _add(self, line: Line) -> None:
        before = self.lines[-1] if self.lines else None
        if before and (before.own != line.own or self._around(before) != self._around(line)):
            self._gap()
        self.lines.append(line)

    def _around(self, line: Line) -> int:
        return self.parent[line.box] if line.own else line.box

    def _gap(self) -> None:
        self.lines.extend([None] * WINDOW)

    def _read(self, html: str) -> None:
        text: list[str] = []
        linked = 0  # characters of the line inside links
        free = False  # whether the line has words outside links
        block = ""  # the element that the line is of
        in_link = False
        stack: list[tuple[str, int]] = [("", 0)]  # open blocks with the innermost box
        opened: Counter[str] = Counter()
        skip: list[str] = []  # open elements since, and with, the one whose text is left out
        skipped: Counter[str] = Counter()
        others = 0  # place in skip, from 1, of an element inside it that holds other texts
        soft = False  # left out by its class or id only, which may be those of a frame around the article
        at, end, tags = 0, len(html), _Tags(html)

        def close_line() -> None:
            nonlocal linked, free
            line = " ".join("".join(text).split())
            box = stack[-1][1]
            # a paragraph or title with words of its own is text, however much of it is links
            own = block == "p" and free or block == "h1"
            if line and (linked * 2 <= len(line) or self.main[box] or own):
                self._add(Line(line, box, stack[-1][0] not in FLOW and stack[-1][0] not in AROUND and box > 0, block == "h1", self.main[box]))
            elif line:
                self._gap()
            text.clear()
            linked, free = 0, False

        def close(name: str) -> None:
            while (top := stack.pop()[0]) != name:
                opened[top] -= 1
            opened[name] -= 1

        def piece(raw: str) -> None:
            nonlocal linked, free
            got = unescape(raw)
            text.append(got)
            if in_link:
                linked += len(got.strip())
            elif not free:
                free = sum(map(str.isalnum, got)) > 2

        while at < end:
            open_ = html.find("<", at)
            if open_ < 0:
                open_ = end
            if open_ > at and not skip:
                piece(html[at:open_])
            if open_ == end:
                break
            at = open_ + 1
            if html.startswith("!--", at):
                stop = html.find("-->", at + 3)
                at = end if stop < 0 else stop + 3
                continue
            if html[at : at + 1] in ("!", "?"):
                stop = html.find(">", at)
                at = end if stop < 0 else stop + 1
                continue
            closing = html[at : at + 1] == "/"
            named = NAME.match(html, at + closing)
            if not named:
                if closing:
                    stop = html.find(">", at)
                    at = end if stop < 0 else stop + 1
                elif not skip:
                    piece("<")
                continue
            name = named.group().lower()
            stop, at = tags.end(named.end())
            attributes = html[named.end() : stop]
            if name in RAW and not closing:
                if not attributes.endswith("/"):
                    raw_end = ENDS[name].search(html, at)
                    at = raw_end.end() if raw_end else end
                continue
            if skip:
                if name in MAIN and not closing and soft and not others and not _holds_others(attributes):
                    skip.clear()  # what holds an article isn't furniture
                    skipped.clear()
                elif closing:
                    if skipped[name]:
                        while (top := skip.pop()) != name:
                            skipped[top] -= 1
                        skipped[name] -= 1
                        if len(skip) < others:
                            others = 0
                    continue
                elif skip == ["p"] and name not in INLINE and name not in VOID:
                    skip.clear()  # a paragraph ends where a block begins
                    skipped.clear()
                else:
                    if name not in VOID and (name not in INLINE or skipped[name]) and not attributes.endswith("/"):
                        skip.append(name)
                        skipped[name] += 1
                        if not others and bool(attributes) and _holds_others(attributes):
                            others = len(skip)
                    continue
            if name == "a":
                in_link = not closing
            if name in INLINE and (closing or not attributes or name == "a"):
                continue
            in_main = self.main[stack[-1][1]]
            leave = not closing and (name in NEVER or name in MAIN and _holds_others(attributes) or name not in MAIN and name not in ("html", "body") and name not in VOID and name != "h1" and bool(attributes) and _is_furniture(attributes, name, in_main))
            if name in INLINE and (not leave or in_link):
                continue
            close_line()
            block = "" if closing else block if name in VOID else name
            if leave:
                self._gap()
                skip, skipped, others, soft = [name], Counter([name]), 0, name not in NEVER and not _holds_others(attributes)
            elif name in VOID:
                continue
            elif closing:
                if opened[name]:
                    close(name)
            else:
                if opened["p"] and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
                    close(stack[-1][0])
                box = stack[-1][1]
                if name not in FLOW and name not in AROUND:
                    self.parent.append(box)
                    self.main.append(self.main[box] or name in MAIN)
                    box = len(self.parent) - 1
                stack.append((name, box))
                opened[name] += 1
        close_line()

    def runs(self) -> list[tuple[int, int, int]]:
        """(surge, dive, fullest window) of each run."""
        lengths = [len(x.text) if x else 0 for x in self.lines]
        sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
        out, surge = [], None
        for i, s in enumerate([*sums, 0]):
            if surge is None and s:
                surge = i
            elif surge is not None and not s:  # dive
                out.append((surge, i, max(sums[surge:i])))
                surge = None
        return out

    def article_box(self, lines: list[Line]) -> int:
        """The innermost box that holds SHARE of the lines' text, of those that hold paragraphs or boxes; a box's number is over its parent's."""
        weight, whole = [0] * len(self.parent), [False] * len(self.parent)
        for x in lines:
            weight[x.box] += len(x.text) * (MARK if x.marked else 1)
            whole[x.box] |= not x.own
        for i in range(len(self.parent) - 1, 0, -1):
            weight[self.parent[i]] += weight[i]
            whole[self.parent[i]] |= weight[i] > 0
        box = 0
        for i in range(1, len(self.parent)):
            if self.parent[i] == box and weight[i] >= SHARE * weight[0] and (whole[i] or self.main[i]):
                box = i
        return box

    def inside(self, box: int) -> list[bool]:
        out = [False] * len(self.parent)
        for i in range(len(self.parent)):
            out[i] = i == box or i > 0 and out[self.parent[i]]
        return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    runs = page.runs()
    if not runs:
        return ""
    lengths = [len(x.text) if x else 0 for x in page.lines]
    full = sorted(s for i in range(len(lengths)) if (s := sum(lengths[i : i + WINDOW])))
    least = min(full[len(full) // 2] / FALL, ENOUGH)
    own = [[x for x in page.lines[a:b] if x] for a, b, _ in runs]
    dense = [most >= least for _, _, most in runs]
    box = page.article_box([x for d, lines in zip(dense, own, strict=True) if d for x in lines])
    inside, marked = page.inside(box), page.main[box]
    paragraphs = sum(len(x.text) * (1 if not x.own else -1) for lines in own for x in lines if inside[x.box]) > 0
    typical = sorted(most for (_, _, most), lines, d in zip(runs, own, dense, strict=True) if d and inside[lines[0].box])
    out: list[str] = []
    for (_, _, most), lines, d in zip(runs, own, dense, strict=True):
        if box and inside[lines[0].box]:
            keep = d or marked or not (lines[0].own and paragraphs)
        elif box:
            keep = not marked and (any(x.title for x in lines) or d and 2 * most >= typical[len(typical) // 2])
        else:
            keep = d or any(x.title for x in lines)
        if keep:
            out += [x.text for x in lines]
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(h if isinstance(h, str) else None) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
