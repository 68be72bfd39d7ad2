"""A small, forgiving HTML reader that both HTML operators share."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]+)>""")
_UNSEEN = {"<!--": "-->", "<![CDATA[": "]]>"}
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the bounds.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BOUND = frozenset("table td th caption html button template article section main body div".split())


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def _token(html: str, at: int, last: int) -> tuple[int, int, re.Match | None] | None:
    """(from, to, match) of the next comment, declaration (no match) or tag; ``last`` is where the last > is."""
    at = html.find("<", at)
    while 0 <= at <= last:
        if m := _TAG.match(html, at):
            return at, m.end(), m
        if html.startswith(("<!", "<?"), at):
            unseen = next((x for x in _UNSEEN if html.startswith(x, at)), None)
            if unseen is None:
                return at, html.find(">", at) + 1, None
            end = html.find(_UNSEEN[unseen], at + len(unseen))
            return at, len(html) if end < 0 else end + 3, None
        at = html.find("<", at + 1)
    begins = [x for x in (html.find(y, at) for y in _UNSEEN) if x >= 0] if at >= 0 else ()
    return (min(begins), len(html), None) if begins else None  # only a comment without an end can begin here


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attribute text), ("close", tag, "") and ("text", "", decoded) in order.

    Comments and the content of script, style and other raw elements are left out, void
    elements only open, and the end tags that HTML lets authors omit are supplied.
    """
    stack: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag, so that no search walks the stack

    def nearest(tags) -> int:
        best = -1
        for t in tags:
            if (at := places.get(t)) and at[-1] > best:
                best = at[-1]
        return best

    def close(at: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > at:
            name = stack.pop()
            places[name].pop()
            yield "close", name, ""

    at, last = 0, html.rfind(">")
    while token := _token(html, at, last):
        start, end, m = token
        if start > at:
            yield "text", "", unescape(html[at:start])
        at = end
        if m is None:
            continue
        slash, tag, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        tag = tag.lower()
        if slash:
            here = nearest((tag,))
            if here >= 0 and (tag in _BOUND or here > nearest(_BOUND)):
                yield from close(here)
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        ends, until = _ENDS.get(tag, ({"p"} if tag in BLOCK else (), _BOUND))
        if tag in BLOCK and tag in _ENDS:
            ends = ends | {"p"}
        here = nearest(ends)
        if here >= 0 and here > nearest(until):
            yield from close(here)
        yield "open", tag, rest
        if tag not in VOID:
            places[tag].append(len(stack))
            stack.append(tag)
    if at < len(html):
        yield "text", "", unescape(html[at:])
    yield from close(0)


def squeeze(parts: list[str]) -> str:
    """The parts as one line: white space becomes one space, none at the ends."""
    return " ".join("".join(parts).split())
