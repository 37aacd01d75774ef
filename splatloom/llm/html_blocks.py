"""HTML pages as sequences of leaf blocks: text with the path of tags above it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

#: Elements whose text is no page text.
_RAW = {name: re.compile(rf"</{name}[\s/]*>", re.I) for name in ("script", "style", "title", "noscript", "template", "textarea", "svg", "iframe")}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements inside a line of text; all others end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ONE_LINE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd option tr td th".split())

TAG_SLOTS = 1024
#: Elements open at once; an element inside so many others is taken as one of the innermost's text.
DEPTH = 96


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # hashed names of the elements above, outermost first; blocks share them
    linked: int  # characters inside links
    marked: bool | None  # what the nearest data-main attribute above says


def _slots(name: str, attributes: str) -> tuple[int, ...]:
    words = [name]
    for kind, *values in _NAMES.findall(attributes):
        value = html.unescape(next((v for v in values if v), "")).lower()
        words += [f"{kind.lower()}:{w}" for w in re.split(r"[^a-z0-9]+", value) if w]
    return tuple(crc32(w.encode()) % TAG_SLOTS for w in words)


class _Tags:
    """The tags of a page in order, found in time that grows with its length, however they are broken.

    An unclosed comment reaches to the end.  A raw element without an end, or closed by its own tag,
    is empty.  Quotes hide a ``>`` unless one of them is left open up to the page's end; from there
    on they hide none.  A ``<`` that opens no tag is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True
        self.endless: set[str] = set()

    def _close(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; there is one behind it."""
        first = self.page.find(">", at)
        x = at
        while self.quoted:
            stop = _STOP.search(self.page, x)
            if stop is None:
                self.quoted = False
            elif stop[0] == ">":
                return stop.start()
            else:
                end = self.page.find(stop[0], stop.end())
                self.quoted, x = end >= 0, end + 1
        return first

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it is an end tag, attributes); comments and raw elements have no name."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0 and start < self.last:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, "", False, ""
                continue
            ends = page.startswith("/", start + 1)
            name = _NAME.match(page, start + 1 + ends)
            if name is None:
                at = start + 1
                if page[at : at + 1] in ("!", "?", "/"):
                    at = page.find(">", at) + 1
                    yield start, at, "", False, ""
                continue
            if name.end() > self.last:
                at = start + 1
                continue
            close = self._close(name.end())
            tag, attributes, at = name[0].lower(), page[name.end() : close], close + 1
            if tag in _RAW and not ends:
                if not attributes.endswith("/") and tag not in self.endless:
                    found = _RAW[tag].search(page, at)
                    if found is None:
                        self.endless.add(tag)
                    else:
                        at = found.end()
                tag = ""
            yield start, at, tag, ends, attributes


class _Open(NamedTuple):
    name: str
    path: tuple[int, ...]
    marked: bool | None


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order, with references decoded and white space folded."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", (), None)]
    deeper: dict[str, int] = {}
    pieces: list[str] = []
    links, linked, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, stack[-1].path, min(linked, len(text)), stack[-1].marked))
        pieces.clear()
        linked = 0

    for start, end, name, ends, attributes in _Tags(page):
        if start > at:
            piece = html.unescape(page[at:start])
            pieces.append(piece)
            linked += len(piece) if links else 0
        at = end
        if not name:
            continue
        if name in _INLINE:
            if name == "a":
                links = 0 if ends else 1
            continue
        close()
        links = 0
        if ends:
            if deeper.get(name):
                deeper[name] -= 1
            elif any(x.name == name for x in stack):
                while stack.pop().name != name:
                    pass
                deeper.clear()
        elif name not in _VOID:
            if stack[-1].name in _ONE_LINE and (name == stack[-1].name or stack[-1].name in ("p", "h1", "h2", "h3")):
                stack.pop()
            if len(stack) > DEPTH:
                deeper[name] = deeper.get(name, 0) + 1
                continue
            mark = stack[-1].marked if "data-main" not in attributes else 'data-main="1"' in attributes
            stack.append(_Open(name, stack[-1].path + _slots(name, attributes), mark))
    pieces.append(html.unescape(page[at:]))
    close()
    return out
