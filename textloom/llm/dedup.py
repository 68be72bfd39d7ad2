"""Near-duplicate groups by b-bit MinHash (operator 6).

1. One pass over the texts gives each row its set digest, its packed b-bit signature
   and one key per band; rows with equal sets collapse into one class.
2. Rows of a band bucket are candidates. A bucket is not expanded into all pairs: each
   member is compared with a few centres of its bucket (the member that meets most
   others, and the least member in two seeded orders).
3. Candidates below the collision-corrected estimate less five standard deviations go;
   the others are confirmed on their full shingle sets.
4. Components are contracted. While buckets hold different components, each member is
   compared with a seeded member of another component of its buckets, the most similar by
   signature is confirmed, and components are contracted again, as long as rounds link enough
   of the members that lie outside of the greatest components. So a family of many texts near the threshold, whose
   links are few but enough, becomes one component by a number of comparisons in proportion
   to its size.
5. What is still torn is compared across components by an exact prefix filter on the
   shingles (length and position bounds), so no link between components is lost. A shingle
   that many of them have is dealt over several tasks, and its pairs are held against the
   signatures inside the join, so pairs far below the threshold are never written.

A family without links whose similarities lie within five deviations below the threshold is
the one case where step 5 still writes pairs in proportion to the square of its size.

Bands of ``rows`` minima are dealt so that a pair at the threshold shares no band with a
probability below 1e-6. Nulls: a null or wordless text has no shingle and joins nothing;
a row without an id takes part, but never names a component unless its class has no id.
Equal rows share a class. Very long texts are read whole, one at a time. Empty tables give
empty results. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import wordkit
from textloom.session import settle, sweep

NIBBLES = 0x1111111111111111
TASK_EDGES = 1 << 13  # so many edges are worth a task of their own


@dataclass(frozen=True)
class NearDup:
    """Production parameters: shingle words, threshold in per cent, MinHash layout."""

    words: int = 5
    percent: int = 80
    rows: int = 4
    miss: float = 1e-6
    seed: int = 20240601
    bits: int = 4  # of each minimum that the packed signature keeps

    @property
    def bands(self) -> int:
        collide = (self.percent / 100) ** self.rows
        return math.ceil(math.log(self.miss) / math.log1p(-collide))

    @property
    def minima(self) -> int:
        return max(128, -(-self.bands * self.rows // 16) * 16)

    @property
    def least_equal(self) -> int:
        """Equal b-bit values that a pair at the threshold has, but once in millions."""
        return self._equal(5)

    @property
    def likely_equal(self) -> int:
        """Equal b-bit values that most pairs at the threshold have."""
        return self._equal(1)

    def _equal(self, deviations: float) -> int:
        p = self.percent / 100 + (1 - self.percent / 100) * 2.0**-self.bits
        return math.floor(self.minima * p - deviations * math.sqrt(self.minima * p * (1 - p)))


def _multipliers(cfg: NearDup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    a = rng.integers(1, 2**63, cfg.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, cfg.minima, dtype=np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """Least 32-bit hash of a set under each of the functions, block by block."""
    least = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(found), block):
        h = (found[i : i + block, None] * a + b) >> np.uint64(32)
        np.minimum(least, h.min(axis=0).astype(np.uint32), out=least)
    return least


def pack(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima, 64 / bits of them to a long."""
    per = 64 // bits
    low = (least.astype(np.uint64) & np.uint64((1 << bits) - 1)).reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64)


def band_keys(least: np.ndarray, cfg: NearDup) -> np.ndarray:
    used = wordkit.mix(least[: cfg.bands * cfg.rows].astype(np.uint64) + np.uint64(cfg.seed)).reshape(cfg.bands, cfg.rows)
    acc = np.arange(cfg.bands, dtype=np.uint64)
    for j in range(cfg.rows):
        acc = wordkit.mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + used[:, j])
    return acc.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, cfg: NearDup) -> DataFrame:
    """Per row: id, a key of its text, set size, set digest, signature and band keys."""
    a, b = _multipliers(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            sizes, classes, signatures, keys = [], [], [], []
            for text in batch.column(2).cast(pa.large_binary()):
                found = wordkit.shingles(wordkit.words(text.as_py(), wordkit.NONSPACE), cfg.words)
                sizes.append(len(found))
                if not len(found):
                    classes.append(None), signatures.append(None), keys.append(None)
                    continue
                cls = wordkit.digest(found)
                if cls not in known:
                    if len(known) > 2000:
                        known.clear()
                    least = minima(found, a, b)
                    known[cls] = pack(least, cfg.bits), band_keys(least, cfg)
                classes.append(cls), signatures.append(known[cls][0]), keys.append(known[cls][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "text_key", "n_shingles", "cls", "sig", "keys"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_key long, n_shingles long, cls binary, sig array<long>, keys array<long>")


def shingle_sets(rows: DataFrame, cfg: NearDup) -> DataFrame:
    """(node, cls, text) to (node, found): sorted shingle hashes, where the digest agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: sets of long texts are large
                found = wordkit.shingles(wordkit.words(batch.column(2)[i].cast(pa.large_binary()).as_py(), wordkit.NONSPACE), cfg.words)
                if len(found) and wordkit.digest(found) == batch.column(1)[i].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["node", "found"])

    return rows.select("node", "cls", "text").mapInArrow(run, "node long, found binary")


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, found_a, found_b) to the pairs (a, b) with 100 * |both| >= percent * |either|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = 0
                if 100 * len(small) >= percent * len(large):
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return sets.select("a", "b", "found_a", "found_b").mapInArrow(run, "a long, b long")


def _spread(sig: str, cfg: NearDup, name: str) -> list[Column]:
    """The longs of a signature as columns, which whole-stage code reads without a check."""
    return [F.coalesce(F.col(sig)[i], F.lit(0)).alias(f"{name}{i}") for i in range(cfg.minima * cfg.bits // 64)]


def differing(x: str, y: str, cfg: NearDup) -> Column:
    """Values of two packed 4-bit signatures that differ, counted on whole longs."""

    def of(i: int) -> Column:
        d = F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))
        two = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseAND(F.lit(NIBBLES)))

    return functools.reduce(Column.__add__, map(of, range(cfg.minima * cfg.bits // 64)))


def _equal_values(pairs: DataFrame, classes: DataFrame, cfg: NearDup) -> DataFrame:
    """Pairs (a, b) with ``equal``, the number of equal values of their signatures."""
    left, right = (classes.select(F.col("node").alias(n), *_spread("sig", cfg, f"s{n}")) for n in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", (cfg.minima - differing("sa", "sb", cfg)).alias("equal"))


def _plausible(pairs: DataFrame, classes: DataFrame, cfg: NearDup) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule out the threshold."""
    return _equal_values(pairs, classes, cfg).filter(F.col("equal") >= cfg.least_equal).select("a", "b")


def _sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, cfg: NearDup, repeats: DataFrame) -> DataFrame:
    """(node, found) for classes given by node, cls, rep and text_key: one text of each is read.

    Only classes whose row is in ``repeats`` (id, text_key of rows that repeat) are gathered,
    as more than one row reads for them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    again = repeats.select(F.col("id").alias("again_id"), F.col("text_key").alias("again_key"), F.lit(True).alias("again"))
    marked = nodes.join(again, (nodes["text_key"] == again["again_key"]) & nodes["rep"].eqNullSafe(again["again_id"]), "left").select("node", "cls", "rep", "text_key", F.coalesce("again", F.lit(False)).alias("again"))
    marked = settle(marked)

    def read(some: DataFrame) -> DataFrame:
        return shingle_sets(texts.join(some, (texts["key"] == some["text_key"]) & texts["id"].eqNullSafe(some["rep"])), cfg)

    once, more = read(marked.filter("not again")), read(marked.filter("again"))
    return once.union(more.groupBy("node").agg(F.first("found").alias("found")))


def _verified(pairs: DataFrame, sets: DataFrame, cfg: NearDup) -> DataFrame:
    """The pairs (a, b), given once each, that hold on the full shingle sets."""
    sweep(sets.sparkSession)
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("found_b"))
    return settle(confirmed(pairs.join(left, "a").join(right, "b"), cfg.percent))


def _tokens(rows: DataFrame) -> DataFrame:
    """(node, root, found) to (node, root, n, found as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, longs), pa.int64()), pa.array(longs, pa.list_(pa.int64()))], names=["node", "root", "n", "tokens"])

    return rows.select("node", "root", "found").mapInArrow(run, "node long, root long, n long, tokens array<long>")


def _prefix_pairs(rows: DataFrame, signatures: DataFrame, cfg: NearDup, hot: int = 1 << 16, block: int = 1 << 24) -> DataFrame:
    """Pairs (a, b) of different roots that can reach the threshold, of rows (node, root, found).

    Exact prefix filter: with shingles in one order, rarest first, two sets at the threshold
    share one of their first n - t n + 1, and the places of the first one they share bound how
    many they can share at all. What only one set has comes first and needs no row.

    Where a shingle has more than ``hot`` pairs to look at, the signatures are compared before
    a pair is written, and the pairs are dealt in squares of about ``block``.
    """
    percent = cfg.percent
    sets = _tokens(rows)
    every = sets.select("node", "root", "n", F.explode("tokens").alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = every.join(often.filter("df > 1").select("token", "df", "lo", "hi"), "token")
    ordered = shared.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token", (F.col("lo") < F.col("hi")).alias("torn")))).alias("sorted"))
    alone = (F.col("n") - F.size("sorted")).cast("int")
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    cut = ordered.withColumn("alone", alone).withColumn("take", prefix - F.col("alone")).filter("take > 0")
    sweep(rows.sparkSession)
    heads = settle(cut.select("node", "root", "n", "alone", F.posexplode(F.slice("sorted", F.lit(1), F.col("take"))).alias("pos", "s")).filter("s.torn").select("node", "root", "n", F.col("s.token").alias("token"), (F.col("pos") + F.col("alone")).alias("at")))
    per = heads.groupBy("token", "root").agg(F.count("*").alias("k"))
    major = per.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots"), F.sum("k").alias("all"), F.max("k").alias("most")).filter("roots > 1")
    major = settle(major.select("token", "major", ((F.col("all") - F.col("most")) * F.col("all")).alias("pairs")))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = (100 + percent) * room >= percent * (F.col("na") + F.col("nb"))
    near = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))

    def sides(torn: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        """The rows outside of a token's greatest root, and all rows."""
        names = {"node": ("a", "b"), "root": ("ra", "rb"), "n": ("na", "nb"), "at": ("pa", "pb")} | {c: (f"sa{c}", f"sb{c}") for c in torn.columns if c.isdigit()}
        x, y = ([F.col(n).alias(to[i]) for n, to in names.items() if n in torn.columns] for i in (0, 1))
        return torn.filter("root <> major").select("token", *more, *x), torn.select("token", *more, *y)

    x, y = sides(heads.join(major.filter(F.col("pairs") <= hot), "token"))
    found = x.join(y, (x["token"] == y["token"]) & (x["ra"] != y["rb"]) & near & need).select("a", "b")

    parts = major.filter(F.col("pairs") > hot).withColumn("parts", F.ceil(F.sqrt(F.col("pairs") / block)))
    x, y = sides(heads.join(parts, "token").join(signatures.select("node", *_spread("sig", cfg, "")), "node"), "parts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    x = x.withColumn("row", F.pmod(F.xxhash64("a"), "parts")).withColumn("col", each).drop("parts")
    y = y.withColumn("col", F.pmod(F.xxhash64("b"), "parts")).withColumn("row", each).drop("parts")
    alike = differing("sa", "sb", cfg) <= cfg.minima - cfg.least_equal
    found = found.union(x.join(y, (x["token"] == y["token"]) & (x["row"] == y["row"]) & (x["col"] == y["col"]) & (x["ra"] != y["rb"]) & near & need & alike).select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _torn(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the members (key, node) of buckets that hold different roots."""
    placed = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    torn = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return settle(placed.join(torn, "key"))


def _outside(torn: DataFrame) -> DataFrame:
    """The rows of ``torn`` that are not of the greatest root of their bucket."""
    per = torn.groupBy("key", "root").agg(F.count("*").alias("k"))
    major = per.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("major"))
    return settle(torn.join(major, "key").filter("root <> major").drop("major"))


def _next_pairs(torn: DataFrame, outside: DataFrame, classes: DataFrame, cfg: NearDup, turn: int, draws: int = 4) -> DataFrame:
    """For each node outside at most one pair: the most similar of the centres that this turn draws from its buckets."""
    centres = F.array(*(F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(turn * draws + i), "node", "key")) for i in range(draws)))
    drawn = torn.groupBy("key").agg(centres.alias("cs")).select("key", F.explode(F.array_distinct("cs")).alias("c"))
    meets = outside.join(drawn, "key").filter(F.col("root") != F.col("c.root")).select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
    best = _equal_values(meets, classes, cfg).filter(F.col("equal") >= cfg.likely_equal).groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contracted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` after the links ``found``: only the roots that these touch are gone through."""
    above = found
    for n in "ab":
        of = roots.select(F.col("node").alias("of"), F.col("root").alias(f"root_{n}"))
        above = above.join(of, above[n] == of["of"], "left").drop("of")
    touched = components(above.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    to = touched.select(F.col("node").alias("of"), F.col("root").alias("to"))
    return settle(roots.join(to, roots["root"] == to["of"], "left").select("node", F.coalesce("to", "root").alias("root")).union(touched))


def merged(links: DataFrame, members: DataFrame, classes: DataFrame, sets: DataFrame, cfg: NearDup, enough: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """Roots after rounds of comparisons in torn buckets, and what is torn then (step 4).

    Rounds go on while each links ``enough`` of the nodes that lie outside of their buckets'
    greatest components, and one in 500 of all that are torn.
    """
    roots, turn = components(links), 0
    torn = _torn(members, roots)
    while not torn.isEmpty():
        outside, turn = _outside(torn), turn + 1
        found = _verified(_next_pairs(torn, outside, classes, cfg, turn), sets, cfg)
        n = found.count()
        if n:
            ends = 500 * n < torn.select("node").distinct().count() or n < enough * outside.select("node").distinct().count()
            roots = _contracted(roots, found)
            torn = _torn(torn, roots)  # a bucket that was whole stays whole
        if not n or ends:
            break
    return roots, torn


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of the edges (a, b), by alternating star contraction.

    Each round hangs neighbours on the least node they see; it needs a number of rounds
    that grows with the logarithm of the largest component. Without an end in ``rounds`` it raises.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        seen = both(e) if large else both(e).filter("v < u")
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = seen.join(least, "u").filter("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    mark = None
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    for _ in range(rounds):
        edges = settle(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        edges = edges.coalesce(1 + now[0] // TASK_EDGES)
        if now == mark or not now[0]:
            sweep(edges.sparkSession)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(docs: DataFrame, cfg: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, text_key, n_shingles, cls, component_id (least id that links reach) and first.

    ``first`` marks rows that carry the least id of their component (all of them, if rows
    with that id and text repeat); a row that joins nothing is its own component.
    """
    rows = settle(sketch(docs, id_col, text_col, cfg))
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.min_by("text_key", "id").alias("text_key"), F.min("text_key").alias("any_key"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = settle(classes.select(F.monotonically_increasing_id().alias("node"), "cls", "rep", F.coalesce("text_key", "any_key").alias("text_key"), "sig", "keys"))

    entries = classes.select("node", F.posexplode("keys").alias("band", "key"))
    order = F.xxhash64("node", F.col("band") % 2)
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", order).alias("centre")).filter("n > 1")
    members = settle(entries.select("key", "node").join(buckets, "key"))
    hubs = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("met"))
    hub = members.join(hubs, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("hub"))
    star = members.select("node", F.col("centre").alias("to")).union(members.join(hub, "key").select("node", F.col("hub").alias("to")))
    pairs = star.filter("node <> to").select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    nodes = classes.select("node", "cls", "rep", "text_key").join(members.select("node").distinct(), "node")
    repeats = rows.filter("cls is not null").groupBy("id", "text_key").count().filter("count > 1")
    sets = settle(_sets(nodes, docs, id_col, text_col, cfg, repeats))
    links = _verified(_plausible(pairs, classes, cfg), sets, cfg)

    roots, torn = merged(links, members, classes, sets, cfg)
    rest = torn.select("node", "root").distinct()
    more = settle(_plausible(_prefix_pairs(rest.join(sets, "node"), classes, cfg), classes, cfg))
    if not more.isEmpty():
        roots = _contracted(roots, _verified(more, sets, cfg))

    named = classes.select("node", "cls", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.filter("root <> node").select("root", "rep").union(roots.select("root").distinct().join(classes.select(F.col("node").alias("root"), "rep"), "root")).groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root", "left").select("cls", F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("id", "text_key", "n_shingles", "cls").join(named, "cls", "left")
    return out.select(
        F.col("id").alias("doc_id"), "text_key", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("cls").isNull() | F.col("id").eqNullSafe(F.col("component_id"))).alias("first")
    )


def keep_first(docs: DataFrame, cfg: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a smaller id of their group already stands for.

    A group keeps one row: rows that repeat the id of the kept one go too. Rows without
    words stay. All columns come back as they were, whatever their names.
    """
    found = settle(groups(docs, cfg, id_col, text_col).filter("cls is not null").drop("cls"))
    firsts = found.filter("first")
    again = settle(firsts.groupBy("component_id").agg(F.min("text_key").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    gone = found.filter("not first").select("doc_id", "text_key")
    repeated = not again.isEmpty()
    if repeated:
        late = firsts.join(again, firsts["component_id"].eqNullSafe(again["component_id"])).filter("text_key <> least")
        gone = gone.union(late.select("doc_id", "text_key"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"))
    kept = keyed.join(gone, (keyed["key"] == gone["gone_key"]) & keyed["id"].eqNullSafe(gone["gone_id"]), "left_anti")
    if repeated:
        one = again.select(F.col("component_id").alias("one_id"), F.col("least").alias("one_key"))
        same = (kept["key"] == one["one_key"]) & kept["id"].eqNullSafe(one["one_id"])
        kept = kept.join(one, same, "left_anti").union(kept.join(one, same, "left_semi").dropDuplicates(["id", "key"]))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
