"""Operator 13: repairs against all sequences of edits, and long conversations in pieces."""

import hashlib
import random
import re
import zlib

import pytest

from textloom.llm import repair

ROWS = "conv_id long, turn long, role string, text string, conv string, block string, audit string, n long"
SPACE = "[\x20\x09-\x0d]"


def damaged(rows):
    """By conversation: the turns (role, text) in order, and their numbers."""
    out = {}
    for conv, turn, role, text in rows:
        of = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            of += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for of in out.values():
        of.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    return out


def faults(of):
    out, seen = [], set()
    for _, role, text in of:
        last = re.findall(f"[^{SPACE[1:]}", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(of, wrong):
    """Least (cost, audit, repaired turns), by trying every edit of every turn and every insert that can still lead to a legal conversation."""
    found = []

    def go(i, cost, audit, said, inserted):
        if not all(r for r, _ in said) or not re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in said)) or found and cost > min(found)[0]:
            return
        if i == len(of):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)):
                found.append((cost, audit, said))
        else:
            _, role, text = of[i]
            go(i + 1, cost + 4, audit + "D", said, 0)
            if wrong[i] not in ("blank", "duplicate"):
                more = 3 * (wrong[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*said, (role, text)], 0)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", [*said, (to, text)], 0)
        if inserted < 2:
            for to in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*said, (to, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return min(found)


def brute(rows, solve=best):
    out = {}
    for conv, of in damaged(rows).items():
        wrong = faults(of)
        numbers = {t for t, _, _ in of if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:]))
        cost, audit, said = solve(of, wrong)
        out[conv] = (gaps, *(wrong.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", 0) for r in rows], ROWS)
    out = repair.repair(repair.damage(df))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = out.collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(1, most + 1)):
            role = rng.choice(["user", "assistant", "assistant", "system", "user", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Go on! ", "what?\n", "", None, "\x0b", "a. b", "Yes."]) if rng.random() < 0.7 else f"{rng.random()}."
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 700]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_are_the_least_of_all_sequences_of_edits(spark, seed):
    rows = conversations(seed, 60, 4)
    assert run(spark, rows) == brute(rows)


def states(of, wrong):
    """The same least repair by a plain loop over turns, for conversations too long to try all."""
    way = {"": (0, "", ())}

    def insert(way):
        for _ in range(2):
            for state, (cost, audit, said) in list(way.items()):
                to = "a" if state == "u" else "u"
                more = (cost + 3, audit + "I", (*said, ("user" if to == "u" else "assistant", "")))
                way[to] = min(way.get(to, more), more)
        return way

    way = insert(way)
    for (_, role, text), fault in zip(of, wrong):
        new: dict = {}
        for state, (cost, audit, said) in way.items():
            to = "a" if state == "u" else "u"
            ways = [(state, (cost + 4, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                cost += 3 * (fault == "truncated")
                ways.append((to, (cost + 3, audit + "R", (*said, ("user" if to == "u" else "assistant", text)))))
                if state + role[:1] in ("s", "u", "su", "ua", "au") and role:
                    ways.append((role[:1], (cost, audit + "K", (*said, (role, text)))))
            for s, w in ways:
                new[s] = min(new.get(s, w), w)
        way = insert(new)
    return min(way[s] for s in ("", "a") if s in way)


def test_the_plain_loop_agrees_with_all_sequences():
    rows = conversations(7, 80, 4)
    assert brute(rows, states) == brute(rows)


def test_long_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 8)
    monkeypatch.setattr(repair, "PIECE", 5)
    rng = random.Random(9)
    role = lambda i: rng.choice(["user", "assistant", "system"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
    rows = [(1, i, role(i), rng.choice(["Yes.", "No", f"{i}."])) for i in range(120)]
    rows += [(2, None, "user", "Yes.")] * 30 + [(2, 3, role(i), f"{i}!") for i in range(20)]  # many turns of one number
    rows += [(c, i, role(i), f"{i}?") for c in range(3, 40) for i in range(rng.randrange(1, 30))]
    assert run(spark, rows) == brute(rows, states)


def test_a_conversation_of_many_turns(spark):
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(6000)]
    assert run(spark, rows) == brute(rows, states)


def test_dropped_and_empty_tables(spark):
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(gone, 0, "user", "a")]) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repair.repair(repair.damage(spark.createDataFrame([], ROWS))).count() == 0
