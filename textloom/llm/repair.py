"""Cheapest repair of the structure of conversations (operator 13).

A conversation's turns must read ``(s?(ua)+)?`` by the initials of their roles: an optional system
turn, then pairs of user and assistant. Edits: Keep costs 0, Rerole to user or assistant 3,
Delete 4 (the only edit of blank and repeated turns), Insert a turn without text 3; a truncated
turn that is not deleted adds 3. The repair is the cheapest sequence of edits, of equally cheap
ones the one whose initials come first in ASCII order.

The edits of one turn are a move between four states of the grammar (nothing yet, after
system, after user, after assistant). The turns are dealt by a hash of conversation and block
of turn numbers. In each batch of a task a recursive DuckDB query advances all
conversations by one turn at a time, and keeps the least cost and audit for each state. A block
other than the first does so from every state it may begin in, so that a conversation may lie in
many tasks: its blocks are 4 x 4 tables of (cost, audit), which a second recursive query joins,
one block at a time for all conversations. (Two prefixes of equal cost that end in one state
are never the beginning of one another, so the lesser audit stays the lesser whatever follows.)
Last, turns and audits are read in order as streams to hash what the audit makes of the turns.

Order: turns by number, null first; turns of one number by role, then by the MD5 of the text.
Nulls: a null role or text is one space, a null number or id one space in the damage key; null ids are
one conversation. A role without a legal initial cannot be kept. Turns of a conversation of any
length and in any number, repeated ones too, are read in bounded memory but for the audit itself,
a character an edit. Empty conversations have zeros, the empty audit and the hash of the empty string. An
empty table gives an empty result. Only the four named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import settle

BLOCK = 512  # turn numbers in a block
PIECE = 1024  # turns that one recursion goes through at most
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of a role may follow, and where it leads.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3


def _after(state: int, cost: int, audit: str, inserts: int = 2) -> Iterator[tuple[int, int, str]]:
    """The state itself and the states that inserted turns lead to from it; more than two never pay."""
    yield state, cost, audit
    if inserts:
        yield from _after(ASSISTANT if state == USER else USER, cost + INSERT, audit + "I", inserts - 1)


def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, from, to, cost, audit): the cheapest way between two states over a turn of each kind.

    A kind is the initial of the role, or ``-`` for any other, then ``x`` if the turn has to go, ``t``
    if it is truncated and ``.`` otherwise. The kind ``0.`` is no turn at all, for inserts before the first.
    """
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for kind in ["0.", *(initial + fault for initial in "sua-" for fault in ".tx")]:
        for state in range(4):
            edits = [(state, DELETE, "D")] if kind != "0." else [(state, 0, "")]
            if kind[1] != "x" and kind != "0.":
                extra = CUT if kind[1] == "t" else 0
                if state in STEPS.get(kind[0], {}):
                    edits.append((STEPS[kind[0]][state], KEEP + extra, "K"))
                edits.append((ASSISTANT if state == USER else USER, REROLE + extra, "R"))
            for edit in edits:
                for to, cost, audit in _after(*edit):
                    best[kind, state, to] = min(best.get((kind, state, to), (1 << 30, "")), (cost, audit))
    return [(kind, state, to, *way) for (kind, state, to), way in best.items()]


#: Least cost and audit of each piece from each state it may begin in to each state, turn by turn.
ADVANCE = """
WITH RECURSIVE best(piece, begun, state, i, cost, audit) USING KEY (piece, begun, state) AS (
  SELECT p.piece, b.begun, m.dst, 0::BIGINT, m.cost, m.audit
  FROM pieces p JOIN (SELECT unnest(range(4))::BIGINT AS begun) b ON NOT p.leads OR b.begun = 0
  JOIN moves m ON m.src = b.begun AND (CASE WHEN p.leads THEN m.kind = '0.' ELSE m.kind = '' END)
  UNION
  (SELECT q.piece, q.begun, q.state, q.i, q.best.cost, q.best.audit FROM (
    SELECT b.piece, b.begun, m.dst AS state, t.i, min({'cost': b.cost + m.cost, 'audit': b.audit || m.audit}) AS best
    FROM best b JOIN turns t ON t.piece = b.piece AND t.i = b.i + 1 JOIN moves m ON m.kind = t.kind AND m.src = b.state
    GROUP BY b.piece, b.begun, m.dst, t.i) q))
SELECT b.piece, b.begun, b.state, b.cost, b.audit FROM best b JOIN pieces p ON p.piece = b.piece AND p.n = b.i
"""

#: The tables of the pieces of each conversation joined, one piece at a time.
JOIN = """
WITH RECURSIVE best(conv, state, i, cost, audit) USING KEY (conv, state) AS (
  SELECT conv, state, i, cost, audit FROM ways WHERE i = 1 AND begun = 0
  UNION
  (SELECT q.conv, q.state, q.i, q.best.cost, q.best.audit FROM (
    SELECT b.conv, w.state, w.i, min({'cost': b.cost + w.cost, 'audit': b.audit || w.audit}) AS best
    FROM best b JOIN ways w ON w.conv = b.conv AND w.i = b.i + 1 AND w.begun = b.state
    GROUP BY b.conv, w.state, w.i) q)),
ends AS (SELECT conv, max(i) AS i FROM ways GROUP BY conv)
SELECT b.conv, min({'cost': b.cost, 'audit': b.audit}) AS best FROM best b JOIN ends USING (conv, i) WHERE b.state IN (0, 3) GROUP BY b.conv
"""


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive) with the stated damage by the CRC of ``conv_id:turn``.

    A dropped turn is kept as a row that is not alive, so that its conversation is known.
    """
    kind = F.crc32(F.encode(F.concat(_text(conv_id), F.lit(":"), _text(turn)), "UTF-8")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text(text), "[.!?]", "")).otherwise(_text(text))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(_text(role)).alias("role"), said.alias("text"), (kind != 0).alias("alive"), F.explode(times).alias("copy"))
    return out.drop("copy")


def turns(rows: DataFrame) -> DataFrame:
    """(conv, block, turn, role, key, kind, alive): what the repair has to know of each turn, without its text."""
    space = "[ \\t-\\r]"
    last = F.regexp_extract("text", f"([^ \\t-\\r]){space}*\\z", 1)
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    fault = F.when(last == "", "x").when(last.isin(".", "!", "?"), ".").otherwise("t")
    block = F.floor(F.col("turn") / BLOCK)
    return rows.select("conv", block.alias("block"), "turn", "role", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("key"), initial.alias("initial"), fault.alias("fault"), "alive")


def _pieces(marked: DataFrame) -> DataFrame:
    """(conv, block, seq, turns' counts, edges, ways) of each run of turns, by the recursive query.

    ``marked`` has the turns of a conversation and block in one task and in order.
    """
    table = moves()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1})
        con.execute("SET enable_progress_bar = false")
        ways = [*table, *(("", s, s, 0, "") for s in range(4))]
        con.register("moves", pa.table({name: pa.array(column) for name, column in zip(("kind", "src", "dst", "cost", "audit"), zip(*ways), strict=True)}))
        before, seq, in_piece = None, 0, 0  # the last turn, and where its piece stands
        for batch in batches:
            piece, number, kinds, rows = [], [], [], []  # of turns; rows: a piece each
            names = batch.column_names
            for conv, block, turn, role, key, initial, fault, seen, leads in zip(*(batch.column(names.index(x)).to_pylist() for x in ("conv", "block", "turn", "role", "key", "initial", "fault", "seen", "leads")), strict=True):
                same_block = before is not None and before[:2] == (conv, block)
                again = seen or same_block and before == (conv, block, turn, role, key)
                if not same_block:
                    seq = in_piece = 0
                elif in_piece == PIECE or not rows:  # a batch ends, a piece too
                    seq, in_piece = seq + 1, 0
                if in_piece == 0:
                    rows.append({"conv": conv, "block": block, "seq": seq, "leads": leads and seq == 0, "n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": initial, "last": initial})
                here = rows[-1]
                if in_piece:
                    here["illegal"] += here["last"] + initial not in ("su", "ua", "au")
                here["last"] = initial
                in_piece += 1
                here["n"] += 1
                here["blank"] += fault == "x"
                here["duplicate"] += again and fault != "x"
                fault = "x" if again else fault
                here["truncated"] += fault == "t"
                piece.append(len(rows) - 1)
                number.append(in_piece)
                kinds.append(initial + fault)
                before = (conv, block, turn, role, key)
            if not rows:
                continue
            for r in rows:
                r["ways"] = []
            of_turn, lengths = np.array(piece), np.array([r["n"] for r in rows])
            all_turns = pa.table({"piece": pa.array(piece, pa.int64()), "i": pa.array(number, pa.int64()), "kind": kinds})
            all_pieces = pa.table({"piece": pa.array(range(len(rows)), pa.int64()), "n": pa.array(lengths), "leads": [r["leads"] for r in rows]})
            # Pieces of about one length together, so that the many steps of long ones look at no others.
            size = np.log2(lengths).astype(int) // 2
            for one in np.unique(size):
                con.register("turns", all_turns.filter(pa.array(size[of_turn] == one)))
                con.register("pieces", all_pieces.filter(pa.array(size == one)))
                for i, begun, state, cost, audit in con.execute(ADVANCE).fetchall():
                    rows[i]["ways"].append({"begun": begun, "state": state, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(rows, schema=schema(batch.schema.field("conv").type))

    def schema(conv: pa.DataType) -> pa.Schema:
        way = pa.struct([("begun", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
        return pa.schema([("conv", conv), ("block", pa.int64()), ("seq", pa.int64()), ("leads", pa.bool_()), *((x, pa.int64()) for x in ("n", "blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), ("ways", pa.list_(way))])

    conv = marked.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{x} long" for x in ("n", "blank", "duplicate", "truncated", "illegal"))
    return marked.mapInArrow(run, f"conv {conv}, block long, seq long, leads boolean, {counts}, first string, last string, ways array<struct<begun:long,state:long,cost:long,audit:string>>")


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit), by the second recursive query.

    ``pieces`` has those of a conversation in one task and in order.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    names = ["blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1})
        con.execute("SET enable_progress_bar = false")

        def solve(rows: list[dict]) -> pa.RecordBatch:
            out, ways = [], []
            for r in rows:
                new = not out or out[-1]["conv"] != r["conv"]
                if new:
                    out.append({"conv": r["conv"], **dict.fromkeys(names, 0), "pieces": 0})
                here = out[-1]
                here["pieces"] += 1
                for name in names:
                    here[name] += r[name]
                if not new:
                    here["illegal"] += here["last"] + r["first"] not in ("su", "ua", "au")
                here["last"] = r["last"]
                ways += [(len(out) - 1, here["pieces"], w["begun"], w["state"], w["cost"], w["audit"]) for w in r["ways"]]
            con.register("ways", pa.table({n: pa.array(c) for n, c in zip(("conv", "i", "begun", "state", "cost", "audit"), zip(*ways), strict=True)}))
            for i, best in con.execute(JOIN).fetchall():
                out[i] |= best
            columns = ["conv", *names, "cost", "audit"]
            return pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in out], schema=pa.schema([("conv", conv_type), *((x, pa.int64()) for x in (*names, "cost")), ("audit", pa.string())]))

        held: list[dict] = []
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            held += batch.to_pylist()
            whole = max((i for i in range(1, len(held)) if held[i]["conv"] != held[i - 1]["conv"]), default=0)
            if whole:  # the last conversation may go on in the next batch
                yield solve(held[:whole])
                held = held[whole:]
        if held:
            yield solve(held)

    return pieces.mapInArrow(run, f"conv {kind}, {', '.join(f'{x} long' for x in (*names, 'cost'))}, audit string")


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns."""
    state = START
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = STEPS[role[0]][state]
        yield role, text


def _hashes(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of rows (conv, audit, role, text), those of a conversation in order behind its audit."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        all_rows, held, conv_type = events(), [], None

        def said() -> Iterator[tuple[str, str]]:
            return ((role, text) for _, _, role, text in all_rows)

        for conv, audit, _, _ in all_rows:  # an audit row; ``replay`` takes the turns behind it
            digest = hashlib.sha256()
            for i, (role, text) in enumerate(replay(audit, said())):
                digest.update(("\n" if i else "").encode() + f"{role}:{text}".encode())
            held.append((conv, digest.hexdigest()))
            if len(held) == 1024:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string() if kind == "string" else pa.int64()), pa.array([y for _, y in held])], names=["conv", "repaired_sha256"])

    return rows.select("conv", "audit", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``damage``: its faults, the cost and audit of its cheapest repair, the repaired hash."""
    kind = "string" if rows.schema["conv"].dataType.simpleString() == "string" else "long"
    rows = rows.withColumn("conv", F.col("conv").cast(kind))
    known = turns(rows)
    every = known.groupBy("conv", "turn").agg(F.max("alive").alias("alive"))  # a row a turn first, so that a long conversation is counted by many tasks
    at = F.when(F.col("alive"), F.col("turn"))
    spans = every.groupBy("conv").agg((F.max(at) - F.min(at) + 1 - F.count(at)).alias("gaps"), F.min(F.when(F.col("alive"), F.struct(F.floor(F.col("turn") / BLOCK).alias("block")))).alias("head"))
    alive = known.filter("alive")
    first = alive.groupBy("conv", "role", "key").agg(F.min(F.struct("turn")).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    a, b = alive.alias("a"), first.alias("b")
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in ("conv", "role", "key")]
    marked = a.join(b, same[0] & same[1] & same[2], "left").select("a.*", (F.col("b.origin").isNotNull() & ~F.struct("a.turn").eqNullSafe(F.col("b.origin"))).alias("seen"))
    a, b = marked.alias("a"), spans.select("conv", "head").alias("b")
    marked = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv"))).select("a.*", F.struct("a.block").eqNullSafe(F.col("b.head")).alias("leads"))
    dealt = marked.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "key")
    pieces = _pieces(dealt).repartition("conv").sortWithinPartitions("conv", "block", "seq")
    solved = settle(_joined(pieces))
    audits = solved.select("conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    said = rows.filter("alive").select("conv", F.lit(1).alias("part"), "turn", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("key"), F.lit(None).cast("string").alias("audit"), "role", "text")
    hashes = _hashes(audits.union(said).repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "key"))
    s, v, h = spans.alias("s"), solved.alias("v"), hashes.alias("h")
    out = s.join(v, F.col("s.conv").eqNullSafe(F.col("v.conv")), "left").join(h, F.col("s.conv").eqNullSafe(F.col("h.conv")), "left")
    counts = [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("s.conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
