"""Leaf blocks of raw HTML: what stands between two block boundaries."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Element names of HTML by what they do to the text flow.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no text of the page; without an end tag it reaches to the page's end.
RAW = set("script style textarea title".split())
#: Drawings, inert and embedded parts: skipped up to their end tag, if there is one.
#: An element of the page that can't be in a drawing ends it, as in browsers.
SKIPPED = set("svg template iframe".split())
END = {t: re.compile(rf"</{t}\s*>", re.I) for t in (RAW | SKIPPED | {"head"}) - {"svg"}}
END["svg"] = re.compile(r"</svg\s*>|(?=</?(?:body|p|div|ul|ol|li|dl|table|tr|td|h[1-6]|blockquote|pre|article|section|main|nav"
                        r"|header|footer|aside|form)[\s/>])", re.I)
#: MathML: a formula is part of the text around it.
MATH = set("math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr "
           "mtd mspace mstyle mpadded mphantom menclose merror semantics annotation".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var".split()) | MATH
#: An opening tag closes an open element of these names, up to the given boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: A tag's attributes as browsers read them: a quote opens a value only behind
#: an equals sign; anywhere else, and without a closing one, it is a character.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                   r"""|<(/?)([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*(?>"[^"]*"|'[^']*'|[^\s"'>][^\s>]*|))*+)>|([^<]+)|(<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?>"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMING = {"class", "id", "role", "itemprop", "aria-label"}
NAME = re.compile(r"[A-Za-z]+")


class Path:
    """The elements above a text. Children share what their parent holds, so
    deep pages take no more than wide ones.

    ``names`` are the distinct words of the path in order, ``last`` the last
    word that is not of the page's frame, ``size`` the number of words.
    """

    __slots__ = ("names", "seen", "last", "size")

    def __init__(self, names: tuple[str, ...] = (), seen: frozenset = frozenset(), last: str = "", size: int = 0):
        self.names, self.seen, self.last, self.size = names, seen, last, size

    def child(self, own: tuple[str, ...]) -> Path:
        new = tuple(t for t in own if t not in self.seen)
        inner = [t for t in own if t not in ("html", "body")]
        return Path(self.names + new if new else self.names, self.seen.union(new) if new else self.seen,
                    inner[-1] if inner else self.last, self.size + len(own))


class OpenElements:
    """The stack of open elements, which also knows where each tag last opened."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[Path] = [Path()]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are not inline

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(self.paths[-1].child(own))

    def last(self, tag: str) -> int:
        """The place of the innermost element of this name, -1 without any."""
        own = self.places.get(tag)
        return own[-1] if own else -1

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.paths.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()


@dataclass
class Block:
    text: str
    path: Path
    link_chars: int


def path_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The words that an element adds to the paths below it."""
    names = [w.lower() for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMING
             for w in NAME.findall(m[2] or m[3] or m[4] or "")]
    return (tag, *dict.fromkeys("." + w for w in names))


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in page order. Text in raw elements, in the head,
    in comments and in tags is no block. Tags that are not closed end with
    their parent; a stray end tag is ignored; a lone ``<`` is text."""
    blocks: list[Block] = []
    stack = OpenElements()
    parts: list[str] = []
    linked = 0
    endless: set[str] = set()  # elements that no end tag follows any more

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack.paths[-1], min(linked, len(text))))
        parts, linked = [], 0

    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        if m is None:  # an unclosed tag at the end
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if m[4] is not None or m[5] is not None:
            parts.append(m[0])
            if stack.last("a") >= 0:
                linked += len(m[0])
        elif not tag:
            continue
        elif m[1]:
            place = stack.last(tag)
            if tag not in INLINE and (place >= 0 or tag == "p"):
                flush()
            # an inline end tag closes nothing across a block
            if place >= 0 and (tag not in INLINE or not stack.blocks or stack.blocks[-1] < place):
                stack.close(place)
        elif tag in RAW or tag in SKIPPED or tag == "head":
            if tag == "svg" and m[3].endswith("/"):
                continue
            flush() if tag != "svg" else None
            if tag not in endless:
                end = END[tag].search(html, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else len(html) if tag in RAW else at
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag not in INLINE:
                flush()
                if (place := stack.last("p")) >= 0:  # a paragraph holds no blocks
                    stack.close(place)
                names, fence = CLOSES.get(tag, ((), ()))
                place = max(map(stack.last, names), default=-1)
                if place > max(map(stack.last, fence), default=-1):
                    stack.close(place)
            if not m[3].endswith("/") or tag in INLINE and tag not in MATH:
                stack.push(tag, path_tokens(tag, m[3]))
    flush()
    return blocks
