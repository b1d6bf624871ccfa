"""HTML to leaf sequences: the runs of text between block borders.

Inline elements and ``<br>`` don't end a block.  Comments, scripts,
styles and other raw or embedded content are skipped whole.  An unclosed
raw-text element (script, style, textarea, title) runs to the end of the
page, as in HTML; of an embedded element without its own end tag only the
start tag is skipped.  Unclosed paragraphs, list items and cells end where
the next one starts.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is no text of the page (raw text, embedded, and
#: of the embedded those that may close themselves), void elements, inline
#: elements, and what a start tag closes.  Fixed values of HTML.
_RAW = set("script style textarea title".split())
_EMBEDDED = set("template noscript iframe svg math object canvas select".split())
_FOREIGN = {"svg", "math"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
              "span strike strong sub sup time tt u var wbr".split())
_SIBLINGS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^>"'])*+"""
_RAW_CONTENT = rf"<({'|'.join(sorted(_RAW))})(?=[\s/>]){_ATTRS}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
_COMMENT = r"<!--.*?(?:-->|\Z)"
_TOKEN = re.compile(rf"{_COMMENT}|{_RAW_CONTENT}|<(/?)([a-z][^\s/>]*)({_ATTRS})>|</?[a-z][^>]*>|<[!?/][^>]*>", re.S | re.I)
#: Start and end tags of an embedded element.  Inside svg and math a script or title is no raw text.
_PAIRS = {t: re.compile(rf"{_COMMENT}|{'()' if t in _FOREIGN else _RAW_CONTENT + '|'}<(/?)({t if t in _FOREIGN else t + '|svg|math'})(?=[\s/>])({_ATTRS})>", re.S | re.I)
          for t in _EMBEDDED}
_UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")


def _self_closed(attrs: str) -> bool:
    return attrs.endswith("/") and not _UNQUOTED.search(attrs)


def _ends(page: str, tag: str, closed: dict[str, dict[int, int]]) -> dict[int, int]:
    """Where the content of each closed ``tag`` starts, and where its end tag ends.

    ``closed`` keeps these for all names asked for, so a page is read once per name."""
    if tag in closed:
        return closed[tag]
    out = closed[tag] = {}
    opened: list[int] = []
    at = 0
    while m := _PAIRS[tag].search(page, at):
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if name == tag and opened:
                out[opened.pop()] = at
        elif name in _FOREIGN and _self_closed(m[4]):
            continue
        elif name == tag:
            opened.append(at)
        else:
            at = _ends(page, name, closed).get(at, at)
    return out


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  #: (tag, attributes) from the outside in
    linked: int  #: characters inside links


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links = 0, 0
    said = False  # whether the block has more than white space so far
    home: tuple = ()

    def flush() -> None:
        nonlocal linked, said
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, home, linked))
            parts.clear()
        linked, said = 0, False

    def say(s: str) -> None:
        nonlocal linked, home, said
        if not s:
            return
        words = bool(s.strip())
        if not parts or (words and not said):
            home = tuple(stack)
        said = said or words
        parts.append(s)
        if links:
            linked += len(s)

    def pop(i: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    at = 0
    closed: dict[str, dict[int, int]] = {}
    while m := _TOKEN.search(page, at):
        say(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _EMBEDDED and not m[2]:
            if not (tag in _FOREIGN and _self_closed(m[4])):
                at = _ends(page, tag, closed).get(at, at)
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            ends = _SIBLINGS.get(tag, set()) | {"p"}
            scope = _SCOPE.get(tag, set())
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t in ends:
                    pop(i)
                    break
                if t in scope or t not in _INLINE and t not in ends and not scope:
                    break
        stack.append((tag, m[4]))
        if tag == "a":
            links += 1
    say(page[at:])
    flush()
    return out
