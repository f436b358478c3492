"""What of a page is text: one walk from left to right over its tags.

``Page`` reads the markup once into pieces: text, tags, and elements that hold no text (``RAW``), which end at their own closing tag.
Every search goes on where the last one ended, and one that has found nothing isn't made again, so the walk takes time
in proportion to the page, whatever its markup. Over the pieces, open elements are counted to find the main content's own end, and
regions are skipped: elements of ``GONE``, and any element whose id or class has ``MARK`` in it, up to the next closing tag.

Where markup is broken: '<' before white space or the end is text; a tag that never ends takes the rest; an element
without its closing tag loses its tags only; a comment without its end is a tag.
"""

from __future__ import annotations

import re

#: Elements that go with their inside (the first of them can't hold markup), the word that marks others in an id
#: or class, and the elements and the id that hold the main content.
RAW = ("script", "style")
GONE = (*RAW, "nav", "footer")
MARK = "footer"
MAIN_TAGS = ("div", "main", "article", "section")
MAIN_ID = "main-content"
_SPACE = " \t\n\r\x0b\x0c"
_NAME = re.compile(r"/?[^\s/>]*")
#: A quoted attribute behind white space; nothing in it gives back what it has taken.
_QUOTED = re.compile(r"(?<=\s)([^\s=>\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')")

TEXT, TAG, ELEMENT = 0, 1, 2


def _value(raw: str, name: str) -> str:
    """A tag's quoted attribute, in lower case; empty if it has none."""
    return next((m[2] or m[3] or "" for m in _QUOTED.finditer(raw) if m[1].lower() == name), "").lower()


class Page:
    """Pieces of a page: (kind, start, end, name); the name of a closing tag begins with '/'."""

    def __init__(self, html: str):
        self.html = html
        self.pieces: list[tuple[int, int, int, str]] = []
        self._missing: set[str] = set()  # what no further search can find
        at = text = 0
        while (start := html.find("<", at)) >= 0:
            found = self._markup(start)
            if found is None:
                at = start + 1
                continue
            if text < start:
                self.pieces.append((TEXT, text, start, ""))
            if found[3]:
                self.pieces.append(found)
            at = text = found[2]
        if text < len(html):
            self.pieces.append((TEXT, text, len(html), ""))

    def _find(self, what: str, at: int) -> int:
        got = -1 if what in self._missing else self.html.find(what, at)
        if got < 0:
            self._missing.add(what)
        return got

    def _markup(self, start: int) -> tuple[int, int, int, str] | None:
        """The comment (without a name), element or tag that begins here, or None for a '<' of the text."""
        html = self.html
        if html.startswith("<!--", start) and (end := self._find("-->", start + 4)) >= 0:
            return ELEMENT, start, end + 3, ""
        if start + 1 >= len(html) or html[start + 1] in _SPACE:
            return None
        name = _NAME.match(html, start + 1)[0].lower()
        end = self._find(">", start) + 1 or len(html)
        if name in RAW and name not in self._missing:
            close = re.compile(f"</{name}\\s*+>", re.I).search(html, end)
            if close:
                return ELEMENT, start, close.end(), name
            self._missing.add(name)
        return TAG, start, end, name or "?"

    def _raw(self, piece: tuple[int, int, int, str]) -> str:
        return self.html[piece[1] : piece[2]]

    def main(self) -> tuple[int, int] | None:
        """The pieces inside the first element with the main content's id, up to its own closing tag; None if that is missing."""
        for i, piece in enumerate(self.pieces):
            if piece[0] == TAG and piece[3] in MAIN_TAGS and MAIN_ID in (raw := self._raw(piece)).lower() and _value(raw, "id") == MAIN_ID:
                depth = 1
                for k in range(i + 1, len(self.pieces)):
                    depth += {piece[3]: 1, "/" + piece[3]: -1}.get(self.pieces[k][3], 0)
                    if not depth:
                        return i + 1, k
                return None
        return None

    def body(self) -> tuple[int, int]:
        """The pieces of the body, or all of them if its opening or closing tag is missing."""
        names = [piece[3] for piece in self.pieces]
        if "body" in names and "/body" in names[(first := names.index("body")) :]:
            return first + 1, names.index("/body", first)
        return 0, len(names)

    def text(self) -> str:
        """Text of the main content or the body, without the regions that go. Character references stay as they are."""
        first, last = self.main() or self.body()
        own = self.pieces[first:last]
        # where the next closing tag of each name, and of any, is: from the right, once
        ahead: dict[str, int] = {}
        close: list[int | None] = [None] * len(own)
        for i in range(len(own) - 1, -1, -1):
            kind, _, _, name = own[i]
            if kind == TAG and name in GONE:
                close[i] = ahead.get("/" + name)
            if kind == TAG and name[0] != "/" and close[i] is None and MARK in (raw := self._raw(own[i])).lower() and (MARK in _value(raw, "id") or MARK in _value(raw, "class")):
                close[i] = ahead.get("/")
            if name[:1] == "/" or kind == ELEMENT:
                ahead[name] = ahead["/"] = i
        out, i = [], 0
        while i < len(own):
            kind, start, end, _ = own[i]
            if kind == TEXT:
                out.append(self.html[start:end])
            i = i + 1 if close[i] is None else close[i] + 1
        return "".join(out)

    def inside(self, span: tuple[int, int] | None) -> str | None:
        """The markup of a run of pieces."""
        if span is None:
            return None
        first, last = span
        begin = self.pieces[first - 1][2] if first else 0
        return self.html[begin : self.pieces[last][1] if last < len(self.pieces) else len(self.html)]
