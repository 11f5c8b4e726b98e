"""HTML to a flat list of tokens with balanced elements, and visible text in blocks.

A small reader for real pages: raw-text elements, comments, unclosed and stray tags, implied ends of
paragraphs, list items and table cells. Every pass is linear in the page.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())
INVISIBLE = frozenset("script style head title template noscript iframe noembed noframes object svg math canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li"
    " main menu nav ol p pre section table ul tr td th".split()
)
#: Opening one of these ends an open element of the right side, up to the named containers.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = frozenset("article aside blockquote body div footer header html li main nav section table td th ul ol dl form figure".split())


class Token(NamedTuple):
    kind: str  # "open", "close" or "text"
    name: str
    value: object  # attributes of an element that opens, characters of a text


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t\r") else {}


def tokens(page: str) -> list[Token]:
    """Balanced tokens: each "open" of a non-void element has its "close"; void ones have none."""
    out: list[Token] = []
    stack: list[str] = []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            out.append(Token("close", stack.pop(), None))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        raw, name = m[0], m["name"]
        if name is None:
            if raw[0] != "<" or raw == "<":
                out.append(Token("text", "", html.unescape(raw)))
            elif raw.startswith("<![CDATA["):
                out.append(Token("text", "", raw[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m["close"]:
            if name in stack:
                depth = len(stack) - 1 - stack[::-1].index(name)
                if name in INLINE and any(s in SCOPES for s in stack[depth + 1 :]):
                    continue  # a stray end of an inline element does not end blocks
                close_to(depth)
            continue
        if name in CLOSES_P and "p" in stack:
            depth = len(stack) - 1 - stack[::-1].index("p")
            if not any(s in SCOPES for s in stack[depth + 1 :]):
                close_to(depth)
        if name in IMPLIED_END:
            ends, stops = IMPLIED_END[name]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in stops:
                    break
                if stack[depth] in ends:
                    close_to(depth)
                    if name != "tr":
                        break
        attrs = m["attrs"]
        out.append(Token("open", name, attributes(attrs)))
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            stop, after = (end.start(), end.end()) if end else (n, n)
            if stop > at:
                out.append(Token("text", "", html.unescape(page[at:stop]) if name in ("title", "textarea") else page[at:stop]))
            at = after
            out.append(Token("close", name, None))
            continue
        stack.append(name)
    close_to(0)
    return out


class Blocks:
    """Collects characters into blocks; white space inside a block becomes one space."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self._open: list[str] = []

    def add(self, text: str) -> None:
        self._open.append(text)

    def cut(self) -> None:
        if self._open:
            if block := " ".join("".join(self._open).split()):
                self.done.append(block)
            self._open = []

    def text(self) -> str:
        self.cut()
        return "\n".join(self.done)


def visible_text(page: str | None) -> str:
    """All characters a reader sees, a line for each block."""
    blocks, hidden = Blocks(), 0
    for token in tokens(page or ""):
        if token.kind == "text":
            if not hidden:
                blocks.add(token.value)
        elif token.name in INVISIBLE:
            hidden += 1 if token.kind == "open" else -1
            blocks.cut()
        elif token.name == "br":
            blocks.add(" ")
        elif token.name not in INLINE:
            blocks.cut()
    return blocks.text()
