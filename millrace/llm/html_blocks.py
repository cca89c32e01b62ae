"""Leaf blocks of an HTML page: runs of text between block boundaries, with their ancestors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes ol option optgroup p pre search section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
UNSHOWN = frozenset("script style template head title noscript iframe object svg math canvas".split())
CLOSES_P = BLOCK - frozenset("body html head button option optgroup".split())
OWN_CLOSE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
FOREIGN = frozenset(("svg", "math"))
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript template noframes".split())
NAMES = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int
    """Characters inside links."""


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.held: list[str] = []
        self.at: list[tuple[str, tuple[str, ...]]] = []
        self.linked = self.unshown = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            tags = tuple(t for t, _ in self.at)
            self.blocks.append(Block(text, tags, tuple(dict.fromkeys(n for _, names in self.at for n in names)), self.linked))
        self.held, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.close_to("head", UNSHOWN - {"head"})  # its end tag may be left out
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self.close_to("p", BLOCK - {"p"})
            if tag in OWN_CLOSE:
                for other in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                    self.close_to(other, frozenset(OWN_CLOSE[tag].split()))
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        self.open.append((tag, tuple(NAMES.findall(marks))))
        self.unshown += tag in UNSHOWN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN:
            return  # only here does the slash close an element
        if not any(name in FOREIGN for name, _ in self.open):
            self.handle_starttag(tag, attrs)

    def close_to(self, tag: str, walls: frozenset[str]) -> None:
        """Closes the nearest open `tag` and what is in it, if no wall lies between."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.pop(i)
                return
            if name in walls:
                return

    def pop(self, i: int) -> None:
        for name, _ in self.open[i:]:
            self.unshown -= name in UNSHOWN
            self.links -= name == "a"
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        walls = frozenset() if tag in BLOCK or tag in UNSHOWN else frozenset(("td", "th", "table", "article", "section", "div"))
        self.close_to(tag, walls)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.pop(len(self.open) - 1)
        if self.unshown:
            return
        if not self.held or not any(x.strip() for x in self.held):
            self.at = list(self.open)
        self.held.append(data)
        if self.links:
            self.linked += len(data.strip())


#: An element whose content is no markup, up to its end tag; any other tag; a comment by the standard's rules: <!--> and <!---> are whole,
#: --> and --!> end one, and so does the end of the page.
_MARKUP = re.compile(
    r"""(<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?=</\2[\s/>]|\Z)|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>)|<!--(?:-?>|.*?(?:--!?>|\Z))""",
    re.IGNORECASE | re.DOTALL,
)


def without_comments(html: str) -> str:
    """The page without its comments; what looks like one in an attribute, a script or a style stays."""
    return _MARKUP.sub(lambda m: m[1] or "", html) if "<!--" in html else html


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks in page order, white space collapsed, character references decoded; comments, closed or not, leave nothing."""
    if not html:
        return []
    html = without_comments(html)
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # a malformed declaration
        reader = _Reader()
        reader.feed(html.replace("<![", "&lt;!["))
        reader.close()
    reader.flush()
    return reader.blocks
