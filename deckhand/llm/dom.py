"""A page's elements and text, read leniently and in time that grows with the page.

Tags are found from one < to the next; whatever isn't a tag is text. Paragraphs, list items, cells and
options end where the next begins, an unknown end tag is ignored, and an inline end tag never closes a
block. Options stand within the line of their list, apart by spaces. Scripts, styles and the head's title hold no elements and no text of the page. In a drawing only
its text elements and foreign objects show text. The content of all other elements is read like any other.

A quote that never ends is an ordinary character. A tag that never ends takes the rest of the page.
"""

from __future__ import annotations

import html
import re

#: Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title".split())
#: These and what lies in them are completed by a / at the end of the tag; a title there isn't the head's.
FOREIGN = ("svg", "math")
#: What shows text in a drawing.
DRAWN = ("text", "foreignobject")
#: There the / is the end of a value without quotes.
IN_VALUE = re.compile(r"""=\s*[^\s"'>]*/\Z""")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup head hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A new element of the first kind ends an open one of the second, unless one of the third lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "body": (("head",), ()),
}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-label|style|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class _Ends:
    """Where tags end: behind the next > outside quotes. What one search finds, later ones use."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'"}
        #: The next special character for all places between two, and the end of a tag by its first one.
        self.lo = self.hi = -1
        self.known: dict[int, int] = {}

    def special(self, at: int) -> int:
        if not self.lo <= at <= self.hi:
            m = SPECIAL.search(self.source, at)
            self.lo, self.hi = at, m.start() if m else len(self.source)
        return self.hi

    def of(self, at: int) -> int:
        n, passed = len(self.source), []
        end = None
        q = self.special(at)
        while end is None:
            if q >= n:
                end = n
            elif q in self.known:
                end = self.known[q]
            elif self.source[q] == ">":
                end = q + 1
            else:
                passed.append(q)
                c = self.source[q]
                m = SPECIAL.search(self.source, self.source.index(c, q + 1) + 1 if q < self.last[c] else q + 1)
                q = m.start() if m else n
        self.known.update(dict.fromkeys(passed, end))
        return end


class Page:
    """Elements in page order (tags, parents, names from attributes, inline or not) and runs of text.

    A run is (element, block, text): runs of one block belong to one line.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.names, self.runs = ["#"], [-1], [""], []
        self.block = 0
        #: Open elements; for each tag, and for all blocks, their places on that stack.
        self._stack, self._places, self._blocks = [0], {}, []
        ends, at, n, text = _Ends(source), 0, len(source), 0
        while (k := source.find("<", at)) >= 0:
            if source.startswith("<!--", k):
                at = source.find("-->", k + 4)
                at = n if at < 0 else at + 3
                self._text(source, text, k)
            elif source.startswith(("<!", "<?"), k):
                at = source.find(">", k)
                at = n if at < 0 else at + 1
                self._text(source, text, k)
            elif m := NAME.match(source, k + 1):
                self._text(source, text, k)
                at = self._tag(source, m, ends.of(m.end()))
            else:
                at = k + 1
                continue
            text = at
        self._text(source, text, n)

    def _tag(self, source: str, m: re.Match, end: int) -> int:
        """Takes a tag and returns where to go on."""
        tag = m[2].lower()
        if m[1]:
            self._end(tag)
            return end
        attributes = source[m.end() : end].removesuffix(">")
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                self.runs.append((self._stack[-1], self.block, " " if tag == "br" else ""))
            elif tag == "hr":
                self.block += 1
            return end
        self._start(tag, attributes)
        foreign = self._last(FOREIGN) > 0
        if tag in RAW and not (tag == "title" and foreign):
            self._cut(len(self._stack) - 1)
            found = RAW_END[tag].search(source, end)
            return found.end() if found else len(source)
        if foreign and attributes.endswith("/") and not IN_VALUE.search(attributes[-1000:]):
            self._cut(len(self._stack) - 1)
        return end

    def _text(self, source: str, lo: int, hi: int) -> None:
        if lo < hi and self._last(("svg",)) <= self._last(DRAWN):
            text = source[lo:hi]
            self.runs.append((self._stack[-1], self.block, html.unescape(text) if "&" in text else text))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.block += 1
            self._close(("p",), ("table", "td", "button"))
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in BLOCKS:
            self._blocks.append(len(self._stack))
        elif tag in ENDS:
            self.runs.append((self._stack[-1], self.block, " "))
        self._places.setdefault(tag, []).append(len(self._stack))
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.names.append(" ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower() if attributes.strip() else "")
        self._stack.append(len(self.tags) - 1)

    def _cut(self, place: int) -> None:
        """Ends the open elements from a place of the stack on."""
        for element in reversed(self._stack[place:]):
            tag = self.tags[element]
            self._places[tag].pop()
            if tag in BLOCKS:
                self._blocks.pop()
        del self._stack[place:]

    def _last(self, tags: tuple) -> int:
        """The highest place of an open element of these tags, or 0."""
        return max((p[-1] for t in tags if (p := self._places.get(t))), default=0)

    def _close(self, tags: tuple, fence: tuple) -> None:
        place = self._last(tags)
        if place > self._last(fence):
            self._cut(place)

    def _end(self, tag: str) -> None:
        place = self._last((tag,))
        if tag in BLOCKS:
            self.block += 1
        elif self._blocks and self._blocks[-1] > place:
            return
        if place:
            self._cut(place)

    def lines(self, keep) -> list[str]:
        """The text of blocks, of the runs whose element is kept; white space becomes one space."""
        found, block, parts = [], None, []
        for element, b, text in [*self.runs, (0, -1, "")]:
            if b != block:
                line = " ".join("".join(parts).split())
                if line:
                    found.append(line)
                block, parts = b, []
            if b >= 0 and keep[element]:
                parts.append(text)
        return found
