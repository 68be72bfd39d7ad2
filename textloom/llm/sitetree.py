"""Main text of web pages by site style trees (operator 1).

Pages of one host are merged into a tree of element paths. A leaf path is important if
its content differs between the pages that have it: its importance is one minus the mean
entropy (to the base of their number) of its contents over them. An inner path combines the
entropy of its presentation (the sequence of its child tags) with the importance of its
leaves, damped by the number of children. A leaf is cut if its importance, drawn towards
what the markup says as if that were two further pages, is below ``threshold``. The markup
says so where a page marks its article: important inside, unimportant outside. It says
nothing where the marked text is not the page's main branch, which is the one with most text
that is not cut, weighted by the importance of the inner path. Branches that the markup names
as menus, adverts, notices, forms, comments and so on have no part in the tree and are cut.

Pages of a host that say the same are one page to the tree. The nodes are grouped by (host,
path, content) with partial sums, so a host with a third of the pages is counted where its
pages lie. Paths of one page are left out of the tree: nothing is known of them.

Nulls: null html is the empty page; a null or odd url has the empty host. An empty page
has empty text. Repeated rows come back as often as they came in. Very long and very deep
pages are read whole, in time that grows with their length. Of branches with equal weight the
first one is the main branch. An empty table gives an empty result. Only the id, url and
html columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import markup
from textloom.session import settle

#: Elements that never hold article text.
GONE = frozenset("nav footer aside form button select dialog menu search object applet canvas svg math audio video noscript head fieldset".split())
#: Words of class, id and role that name a branch as noise.
NOISE = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer dialog disqus footer form gdpr login menu menus menubar modal nav navbar navigation navigate newsletter notice notices notification pager pagination popup promo promos promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets masthead rail".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """A run of text between block boundaries."""

    path: int
    parent: int
    text: str
    marked: bool  # inside the branch that the page marks as its article
    noise: bool
    links: int = 0
    heading: bool = False


#: (path, leaf) to importance and number of pages; a path that is not in it is on one page.
Tree = dict[tuple[int, bool], tuple[float, int]]


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    styles: list[tuple[int, int]] = field(default_factory=list)  # (path, hash of the child tags)


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _named(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is noise by its tag or by what its attributes call it."""
    if tag in GONE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main") or tag in _HEADINGS:
        return tag == "article" and bool({"comment", "reply"} & set(_words(attrs)))
    words = _words(attrs)
    if NOISE.intersection(words):
        return True
    return not in_article and (tag == "header" or "header" in words and not {"article", "post", "entry", "content"}.intersection(words))


def _words(attrs: dict[str, str]) -> list[str]:
    return [w.lower() for name in ("class", "id", "role") if name in attrs for w in _WORD.findall(attrs[name])]


def parse(html: str | None) -> Page:
    """Blocks of a page in order, and the presentation of its block elements."""
    page = Page()
    root = _hash("")
    # (tag, path and parent's path of the nearest block element, noise, marked, child tags,
    # in the header of an article, in a heading)
    stack: list[tuple] = [("", root, root, False, False, [], False, False)]
    parts: list[str] = []
    links = anchors = 0

    def flush() -> None:
        nonlocal links
        text = markup.squeeze(parts)
        parts.clear()
        if text:
            _, path, parent, noise, marked, _, header, heading = stack[-1]
            page.blocks.append(Block(path, parent, text, marked, noise or header and not heading, links, heading))
        links = 0

    for kind, tag, rest in markup.events(html or ""):
        if kind == "text":
            parts.append(tag or rest)
            if anchors:
                links += len(rest.strip())
            continue
        if tag in markup.BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if kind == "open":
            if tag == "a":
                anchors += 1
            if tag in markup.VOID:
                continue
            _, path, parent, noise, marked, children, header, heading = stack[-1]
            attrs = markup.attributes(rest) if rest.strip() else {}
            if tag in markup.BLOCK:
                children.append(tag)
                path, parent = _hash(path, tag, attrs.get("class", "")), path
            noise = noise or _named(tag, attrs, marked)
            marked = marked or not noise and (tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody")
            stack.append((tag, path, parent, noise, marked, [], header or tag == "header" and marked, heading or tag in _HEADINGS))
        elif len(stack) > 1 and stack[-1][0] == tag:
            if tag == "a":
                anchors = max(0, anchors - 1)
            _, path, *_, children, _, _ = stack.pop()
            if tag in markup.BLOCK:
                page.styles.append((path, _hash(*children)))
    flush()
    return page


def main_text(page: Page, tree: Tree, threshold: float = 0.3, prior: float = 2.0) -> str:
    """The article: blocks outside named noise whose importance is not low.

    The markup weighs as much as ``prior`` further pages: inside the marked branch it says
    important, beside it unimportant. Where the marked branch is the main one the text is taken from it
    alone, as text beside it may differ on every page and still be teasers or notes on authors; its headings
    stay, as the pages of a series may share them. Where the main branch is not marked, the
    markup says neither.
    """

    def belief(path: int, leaf: bool, says: float) -> float:
        importance, on = tree.get((path, leaf), (1.0, 1))
        return ((on - 1) * importance + prior * says) / (on - 1 + prior)

    def stays(b: Block, says: float) -> bool:
        return b.marked and b.heading or belief(b.path, True, says) >= threshold

    open_blocks = [b for b in page.blocks if not b.noise]
    weight: dict[int | None, float] = {}
    for b in open_blocks:
        says = 1.0 if b.marked else 0.5
        if stays(b, says):
            branch = None if b.marked else b.parent  # marked text is one branch
            weight[branch] = weight.get(branch, 0.0) + (len(b.text) - b.links) * (prior if b.marked else belief(b.parent, False, says))
    best = max(weight, key=lambda p: round(weight[p], 6), default=0)
    if best is None:
        return "\n\n".join(b.text for b in open_blocks if b.marked and stays(b, 1.0))
    kept = [b for b in open_blocks if belief(b.path, True, 0.5) >= threshold]
    return "\n\n".join(b.text for b in kept if (None if b.marked else b.parent) == best or b.links < 0.8 * len(b.text))


def host(url_col: str):
    """Lower-case host of a URL without its port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, html_key, page, path, parent, leaf, content, first): the nodes of each page's tree.

    ``page`` is a hash of what a page says and ``first`` marks one row of each of its paths.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("host", "html_key", "page", "path", "parent", "leaf", "content", "first")
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in names}
            for name, html, key in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                page = parse(html.as_py())
                blocks = [b for b in page.blocks if not b.noise]
                seen = {(b.path, b.parent, True, _hash(b.text)) for b in blocks}
                inner = {b.parent for b in blocks}
                seen |= {(path, path, False, style) for path, style in page.styles if path in inner}
                says, met = _hash(*(b.text for b in blocks)), set()
                for one in sorted(seen):
                    for column, value in zip(names, (name.as_py(), key.as_py(), says, *one, (one[0], one[2]) not in met), strict=True):
                        rows[column].append(value)
                    met.add((one[0], one[2]))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("host", pa.string()), *((n, pa.int64()) for n in names[1:5]), ("leaf", pa.bool_()), ("content", pa.int64()), ("first", pa.bool_())]))

    rows = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("html_key"))
    return rows.mapInArrow(nodes, "host string, html_key long, page long, path long, parent long, leaf boolean, content long, first boolean")


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html", damping: float = 0.9) -> DataFrame:
    """(host, path, leaf, importance, on) of the paths that two or more different pages have."""
    seen = paths(pages, url_col, html_col).drop("html_key").distinct()
    kinds = seen.groupBy("host", "path", "parent", "leaf", "content").agg(F.count("*").alias("k"), F.sum(F.col("first").cast("long")).alias("firsts"))
    sums = kinds.groupBy("host", "path", "parent", "leaf").agg(F.sum("k").alias("all"), F.sum("firsts").alias("on"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    mean_log = F.col("klogk") / F.col("all")
    of_leaf = 1 - mean_log / F.log("on")  # mean of log_on k: all pages alike gives 1
    of_style = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log("all") - mean_log) / F.log("on")))
    sums = settle(sums)  # a row a host and path; the pages are parsed once for it
    scored = sums.select("host", "path", "parent", "leaf", "on", F.when(F.col("on") < 2, 1.0).when(F.col("leaf"), of_leaf).otherwise(of_style).alias("importance"))
    leaves = scored.filter("leaf")
    under = leaves.groupBy("host", "parent").agg((F.sum(F.col("importance") * F.col("on")) / F.sum("on")).alias("mean"), F.sum("on").alias("children"))
    damp = F.pow(F.lit(damping), F.col("children") / F.col("on"))  # by the children on a page
    inner = scored.filter("not leaf").select("host", F.col("path").alias("parent"), "importance", "on").join(under, ["host", "parent"])
    inner = inner.select("host", F.col("parent").alias("path"), F.lit(False).alias("leaf"), ((1 - damp) * F.col("importance") + damp * F.col("mean")).alias("importance"), "on")
    # Rounded, so that the order of summing decides no tie.
    return leaves.select("host", "path", "leaf", "importance", "on").union(inner).filter("on > 1").withColumn("importance", F.round("importance", 9))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_paths: int = 1 << 17) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    The importances are sent to all tasks once if they number at most ``broadcast_paths`` (25
    bytes each). Otherwise they are joined by host and path to the paths of each page.
    """
    found = settle(importances(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"), F.xxhash64(html_col).alias("html_key"))
    if found.count() <= broadcast_paths:
        shared = pages.sparkSession.sparkContext.broadcast(found.select("host", "path", "leaf", "importance", "on").toArrow())
        trees: dict[str, Tree] = {}

        def tree_of(name: str | None, _) -> Tree:
            if not trees:
                trees[""] = {}
                for of, path, leaf, importance, on in zip(*(c.to_pylist() for c in shared.value.columns), strict=True):
                    trees.setdefault(of, {})[path, leaf] = (importance, on)
            return trees.get(name, {})

        joined = rows.select("page_id", "url", "html", "host", F.lit(None).cast("string").alias("own"))
    else:
        own = paths(pages, url_col, html_col).select("host", "html_key", "path", "leaf").distinct().join(found, ["host", "path", "leaf"])
        own = own.groupBy("host", "html_key").agg(F.collect_list(F.struct("path", "leaf", "importance", "on")).alias("own"))  # no more than the page has paths

        def tree_of(name: str | None, own: pa.Scalar) -> Tree:
            return {(x["path"], x["leaf"]): (x["importance"], x["on"]) for x in own.as_py() or []}

        joined = rows.join(own, ["host", "html_key"], "left").select("page_id", "url", "html", "host", "own")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(parse(html.as_py()), tree_of(name.as_py(), own)) for html, name, own in zip(*batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
