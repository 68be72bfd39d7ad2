"""A tree of HTML elements from the standard parser, with the few queries importers need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SIMPLE = re.compile(r"(?P<tag>[\w-]+)|\.(?P<cls>[\w:/\[\]-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[\^*]?=)\"?(?P<val>[^\"\]]*)\"?)?\]")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def nodes(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                yield one
            else:
                stack += reversed(one.children)

    def text(self, sep: str = "\n") -> str:
        """Trimmed strings that are not blank, joined."""
        return sep.join(s.strip() for s in self.strings() if s.strip())

    def where(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.nodes() if test(n)]

    def select(self, selector: str) -> list[Node]:
        """Elements that one of the comma-separated compound selectors fits."""
        tests = [_compound(s.strip()) for s in selector.split(",")]
        return self.where(lambda n: any(t(n) for t in tests))

    def first(self, selector: str) -> Node | None:
        tests = [_compound(s.strip()) for s in selector.split(",")]
        return next((n for n in self.nodes() if any(t(n) for t in tests)), None)

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def next_element(self, tag: str) -> Node | None:
        """The next sibling of that tag."""
        if self.parent is None:
            return None
        after = self.parent.children[self.parent.children.index(self) + 1 :]
        return next((c for c in after if isinstance(c, Node) and c.tag == tag), None)

    def without(self, selector: str) -> Node:
        """A copy of the tree without the elements that the selector fits."""
        gone = {id(n) for n in self.select(selector)}

        def copy(node: Node, parent: Node | None) -> Node:
            out = Node(node.tag, node.attrs, parent)
            out.children = [c if isinstance(c, str) else copy(c, out) for c in node.children if isinstance(c, str) or id(c) not in gone]
            return out

        return copy(self, None)


def _compound(selector: str) -> Callable[[Node], bool]:
    parts = [m.groupdict() for m in _SIMPLE.finditer(selector)]

    def fits(node: Node) -> bool:
        for p in parts:
            if p["tag"] and node.tag != p["tag"] or p["cls"] and p["cls"] not in node.classes or p["id"] and node.attrs.get("id") != p["id"]:
                return False
            if p["attr"]:
                have = node.attrs.get(p["attr"])
                if have is None or p["op"] == "=" and have != p["val"] or p["op"] == "^=" and not have.startswith(p["val"]) or p["op"] == "*=" and p["val"] not in have:
                    return False
        return True

    return fits


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data) -> None:
        self.at.children.append(data)


def parse(html: str | bytes | None) -> Node:
    builder = _Builder()
    builder.feed(html.decode("utf-8", "ignore") if isinstance(html, bytes) else html or "")
    builder.close()
    return builder.root


_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
_HEAD = {"h2": "##", "h3": "###", "h4": "####"}


def markdown(node: Node, links: bool = False, fences: bool = False) -> str:
    """The element as Markdown: headings, emphasis, lists, rules, code, tables, paragraphs.

    ``links`` keeps links as such unless their text is a citation badge or shorter than three
    characters; ``fences`` names the language of a code block.
    """
    out = _render(node, links, fences)
    out = re.sub(r"\n{4,}" if fences else r"\n{3,}", "\n\n\n" if fences else "\n\n", out)
    lines = [line if line.strip().startswith(("*", "#", "-")) else line.strip() for line in out.split("\n")]
    return "\n".join(lines).strip()


def _render(node: Node, links: bool, fences: bool) -> str:
    """Without recursion: a page that leaves its tags open is as deep as it is long."""
    out: list[str] = []
    begun: list[tuple[int, bool]] = []  # of the list items and links that are open: their place in ``out`` and ``bare`` before them
    bare = False  # whether the innermost of them has no text yet; blanks at its beginning go
    headed: set[int] = set()
    for head in node.nodes():
        if head.tag == "th":
            for n in head.above():
                if id(n) in headed:
                    break
                headed.add(id(n))

    def say(text: str) -> None:
        nonlocal bare
        text = text.lstrip() if bare else text
        if text:
            out.append(text)
            bare = False

    def begin(mark: str = "") -> None:
        nonlocal bare
        begun.append((len(out), bare))
        out.extend([mark] if mark else [])
        bare = True

    def trim(at: int) -> None:
        """Blanks at the end of what came after ``at`` go."""
        while len(out) > at:
            out[-1] = out[-1].rstrip()
            if out[-1]:
                return
            out.pop()

    def end_item() -> None:
        nonlocal bare
        trim(begun.pop()[0])
        bare = False

    def end_link(href: str | None) -> None:
        nonlocal bare
        at, was = begun.pop()
        first = at + (1 if href else 0)
        trim(first)
        if sum(map(len, out[first : first + 3])) < 3:  # no part is empty
            del out[at:]
            bare = was
            return
        out.extend([f"]({href})"] if href else [])
        bare = False

    stack: list[Node | str | Callable[[], None]] = [node]
    while stack:
        one = stack.pop()
        if isinstance(one, str):
            say(one)
        elif isinstance(one, Node):
            stack += reversed(_parts(one, links, fences, id(one) in headed, begin, end_item, end_link))
        else:
            one()
    return "".join(out)


def _parts(node: Node, links: bool, fences: bool, headed: bool, begin: Callable, end_item: Callable, end_link: Callable) -> list:
    """What an element is written as: texts, elements and steps, in order."""
    tag, inner = node.tag, node.children
    if tag in _HEAD:
        return [f"\n{_HEAD[tag]} ", *inner, "\n"]
    if tag in _WRAP:
        return [_WRAP[tag], *inner, _WRAP[tag]]
    if tag == "hr":
        return ["\n\n---\n\n"]
    if tag in ("ul", "ol"):
        items = [c for c in inner if isinstance(c, Node) and c.tag == "li"]
        return [x for i in items for x in ("\n", "  * ", begin, *i.children, end_item)] + ["\n"] if items else inner
    if tag == "pre":
        code = node.first("code")
        name = next((c.removeprefix("language-") for c in (code.classes if code else []) if c.startswith("language-")), "") if fences else ""
        return [f"\n```{name}\n", *node.strings(), "\n```\n"]
    if tag == "table" and headed:
        heads = [h.text("") for h in node.select("th")]
        rows = [[d.text("") for d in r.select("td")] for r in node.select("tr")]
        body = "".join(f"| {' | '.join(r)} |\n" for r in rows if r)
        return [f"\n\n| {' | '.join(heads)} |\n| {' | '.join(['---'] * len(heads))} |\n{body}\n"]
    if tag == "p":
        return [*inner, "\n\n"]
    if tag == "a" and links:
        if "citation" in node.attrs.get("class", ""):
            return []
        href = node.attrs.get("href")
        return [lambda: begin("[" if href else ""), *inner, lambda: end_link(href)]
    return inner
