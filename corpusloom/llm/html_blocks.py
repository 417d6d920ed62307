"""Leaf blocks of an HTML page: runs of text between block tags, with what they stand in."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

#: Tags that do not begin or end a block of text.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img input ins kbd label mark math object q rp rt ruby "
    "s samp small span strike strong sub sup svg time tt u var video wbr".split()
)
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is raw text, not of the page, up to their end tag or the end of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose text is left out, up to where they or an ancestor end.
SKIPPED = frozenset("template select".split())
#: A start tag that ends an open element of these kinds, up to one of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_COMMENT_END = re.compile(r"--!?>")
_TAG_NAME = re.compile(r"[^\s/>]*")
_IN_TAG = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    """Text with white space made plain, the features of its ancestors, and the nearest block tags."""

    text: str
    above: frozenset[str]
    tag: str
    parent: str
    linked: int  # letters inside links


def _attribute_features(attributes: str) -> list[str]:
    out = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "style":
            out += ["hidden"] * bool(_HIDDEN.search(value))
        elif name == "hidden" or name == "aria-hidden":
            out += ["hidden"] * (value.lower() != "false")
        else:
            for token in _NAME.findall(value):
                token = token.lower()
                out.append(f"{'r' if name == 'role' else 'c'}={token}")
                if len(token) >= 5 and name != "role":
                    out.append(f"k={token[:4]}")
    return out


class _Scanner:
    """Cuts a page into text and tags in time proportional to its length.

    A tag ends at the first > outside quotes. If there is none, because a quote isn't closed, it ends
    at the first > at all; looking for quotes in vain may pass over as many characters as the page
    has, and once they are used up tags end at the first >. Without a > after it, a < is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.vain = page, page.rfind(">"), len(page)
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.raw_end: dict[str, re.Pattern] = {}
        self.raw_none: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at `at` has its >."""
        page, place = self.page, at
        while self.vain > 0:
            found = _IN_TAG.search(page, place)
            if found is None:
                break
            mark = found[0]
            if mark == ">":
                return found.start()
            if self.last_quote[mark] <= found.start():
                place = len(page)
                break
            place = page.find(mark, found.end()) + 1
        self.vain -= min(place, len(page)) - at
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(where text from `at` ends, where to go on, '/' or '', tag or '', attributes); a tag '' is only skipped."""
        page = self.page
        found = _START.search(page, at)
        while found:
            begin = found.start()
            kind = found[0]
            if kind == "<!--":
                if page.startswith((">", "->"), begin + 4):
                    return begin, page.index(">", begin) + 1, "", "", ""
                stop = _COMMENT_END.search(page, begin + 4)
                return begin, stop.end() if stop else len(page), "", "", ""
            if begin > self.last:
                break
            if kind in ("<!", "<?"):
                return begin, page.index(">", begin) + 1, "", "", ""
            shut = "/" if kind[1] == "/" else ""
            name = _TAG_NAME.match(page, begin + 1 + len(shut))
            end = self.tag_end(name.end())
            return begin, end + 1, shut, name[0].lower(), page[name.end() : end]
        return len(page), len(page), "", "", ""

    def after_raw(self, tag: str, at: int) -> int:
        """Where the raw text of an element ends, with its end tag."""
        if tag in self.raw_none:
            return len(self.page)
        if tag not in self.raw_end:
            self.raw_end[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)
        stop = self.raw_end[tag].search(self.page, at)
        if stop is None or stop.start() > self.last:
            self.raw_none.add(tag)
            return len(self.page)
        return self.page.index(">", stop.end()) + 1


@dataclass
class _Open:
    """An open element: features down to it, the nearest block tags, and where the nearest block is in the stack."""

    tag: str
    above: frozenset[str]
    block: str
    parent: str
    block_at: int


_ROOT = _Open("", frozenset(), "", "", -1)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; comments, scripts, styles, options and other raw content are left out.

    Character references are decoded. Inline tags and comments join the text at both sides as it
    is, a line break is white space, any other tag ends a block. Broken markup is read much as
    browsers do: missing end tags are implied, end tags without a start ignored, and a raw element
    without an end tag takes the rest of the page. Time is in proportion to the page's length,
    however it is nested or broken.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    parts: list[str] = []
    linked = 0
    known: dict[tuple, frozenset[str]] = {}
    scan = _Scanner(page)

    def top() -> _Open:
        return stack[-1] if stack else _ROOT

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            now = top()
            out.append(Block(text, now.above, now.block, now.parent, linked))
        linked = 0

    def close(depth: int) -> None:
        for element in stack[depth:]:
            places[element.tag].pop()
        del stack[depth:]

    def open_(element: _Open) -> None:
        places.setdefault(element.tag, []).append(len(stack))
        stack.append(element)

    at, end = 0, len(page)
    while at < end:
        upto, further, shut, tag, attributes = scan.next(at)
        if upto > at and last(SKIPPED) < 0:
            text = page[at:upto]
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if places.get("a") else 0
        at = further
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if shut:
            depth = last((tag,))
            if tag in INLINE:
                if depth > top().block_at:  # an inline end tag closes no block
                    close(depth)
                continue
            end_block()
            if depth >= 0:
                close(depth)
            continue
        if tag in RAW:
            end_block()
            at = scan.after_raw(tag, at)
            continue
        if tag not in INLINE:
            end_block()
            if tag in IMPLIED:
                ended, scope = IMPLIED[tag]
                depth = last(ended)
                if depth > last(scope):
                    close(depth)
            elif tag not in VOID and top().block == "p":
                close(top().block_at)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math"):
            continue
        now = top()
        if tag in INLINE:
            open_(_Open(tag, now.above, now.block, now.parent, now.block_at))
            continue
        key = (now.above, tag, attributes)
        if key not in known:
            known[key] = now.above | {f"t={tag}", *_attribute_features(attributes)}
        open_(_Open(tag, known[key], tag, now.block, len(stack)))
    end_block()
    return out
