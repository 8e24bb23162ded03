"""Conversation repair against exhaustive search and against the contract, row by row."""

import hashlib
import random
import re
import zlib

import pytest

from sqlcorpus.llm import queries, repair

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, times string, `cost` string, `odd n` int"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits; rows: (role, text, must_go, unfinished)."""
    best = (4 * len(rows), "D" * len(rows), [])

    def go(i, roles, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and GOOD.fullmatch(roles) and (cost, audit) < best[:2]:
            best = (cost, audit, out)
        for name in ("user", "assistant"):  # no cheap repair has three inserted rows together
            if not audit.endswith("III"):
                go(i, roles + name[0], cost + 3, audit + "I", [*out, f"{name}:"])
        if i == len(rows):
            return
        role, text, must_go, unfinished = rows[i]
        go(i + 1, roles, cost + 4, audit + "D", out)
        if must_go:
            return
        more = 3 if unfinished else 0
        go(i + 1, roles + (role[:1] or "-"), cost + more, audit + "K", [*out, f"{role}:{text}"])
        for name in ("user", "assistant"):
            go(i + 1, roles + name[0], cost + 3 + more, audit + "R", [*out, f"{name}:{text}"])

    go(0, "", 0, "", [])
    return best


def expected(conv, rows, damage=True):
    """The contract's row for one conversation; rows: (turn, role, text)."""
    made = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in made:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:]))
    turns = [t for t, _, _ in made if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = cheapest(judged)
    return conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(seed, convs, most):
    rng = random.Random(seed)
    out = []
    for conv in range(convs):
        for _ in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["yes.", "no", "Why?", " ", None, "", "so!\n", "é…", "yes."])
            out.append((conv, rng.choice([None, *range(6)]), role, text))
    return out


def by_conversation(rows):
    convs = {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(tuple(row))
    return convs


@pytest.mark.parametrize("damage", [True, False])
def test_equal_to_exhaustive_search(spark, damage):
    given = conversations(3 + damage, 60, 5) + [(None, 1, "user", "Hello."), (None, 2, "assistant", None)]
    rows = spark.createDataFrame([(*r, "x", "y", 1) for r in given], SCHEMA)
    edits = repair.repair_conversations(repair.damaged(rows), "times") if damage else repair.repair_conversations(rows)
    found = sorted((tuple(r) for r in repair.report(edits).collect()), key=str)
    assert found == sorted((expected(c, r, damage) for c, r in by_conversation(given).items()), key=str)


def test_query_on_given_rows(spark, given):
    found = queries.op11_conversation_repair(spark, given)
    assert found.dtypes == [
        ("conv_id", "bigint"), ("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"),
        ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string")]
    rows = by_conversation([tuple(r) for r in queries.table(spark, given, "conversations").select("conv_id", "turn", "role", "text").collect()])
    short = {c: r for c, r in rows.items() if len(r) <= 6}
    assert {tuple(r) for r in found.collect() if r["conv_id"] in short} == {expected(c, r) for c, r in short.items()}
    assert found.count() == len(rows)


def test_edits_are_the_repaired_conversation(spark):
    rows = [(1, 1, "user", "Hi."), (1, 3, "assistant", "Hello"), (1, 4, "user", "Hi."), (1, 5, "user", "More?"), (2, 1, "user", "")]
    edits = repair.repair_conversations(spark.createDataFrame([(*r, None, None, 1) for r in rows], SCHEMA)).collect()
    assert [(r["conv_id"], r["seq"], r["edit"], r["turn"], r["role"], r["fault"], r["illegal"], r["gap"], r["cost"]) for r in sorted(edits)] == [
        (1, 0, "K", 1, "user", None, False, 0, 0), (1, 1, "K", 3, "assistant", "truncated", False, 1, 0),
        (1, 2, "D", 4, "user", "duplicate", False, 0, 0), (1, 3, "K", 5, "user", None, True, 0, 0), (1, 4, "I", None, "assistant", None, False, 0, 10),
        (2, 0, "D", 1, "user", "blank", False, 0, 4)]


def test_dropped_conversations_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", 0), (2, 1, "user", "Hi.", 3)], "conv_id long, turn long, role string, text string, times int")
    found = {r["conv_id"]: r for r in repair.report(repair.repair_conversations(rows, "times")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(found[1]) == (1, 0, 0, 0, 0, 0, 0, "", nothing)
    assert found[2]["duplicate"] == 2 and found[2]["illegal"] == 2 and found[2]["audit"] == "DDD" or found[2]["audit"] == "KDDI"
    assert repair.report(repair.repair_conversations(rows.where("false"))).collect() == []


def search(rows):
    """Edits of one conversation and how many nodes were alive at most; rows: (role, fault)."""
    s, out, most = repair.Survivors(), [], 0

    def alive():
        nodes, stack = 0, [s.root]
        while stack:
            node = stack.pop()
            nodes += 1
            stack += node.kids
        return nodes

    for k, (role, fault) in enumerate(rows):
        s.step((k, role, "", fault, False, 0), role[:1], fault == "blank", fault == "truncated")
        out += [n.edit for n in s.settled()]
        if k % 50 == 0:
            most = max(most, alive())
    cost, rest = s.finish()
    return cost, "".join([*out, *(n.edit for n in rest)]), most


def test_long_conversations_are_emitted_as_they_are_settled():
    rng = random.Random(5)
    rows = [(rng.choice(["user", "assistant", "tool"]), rng.choice([None, None, "truncated", "blank"])) for _ in range(20_000)]
    cost, audit, most = search(rows)
    assert most < 200
    assert sum(c != "I" for c in audit) == 20_000
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[c] for c in audit) + 3 * sum(
        f == "truncated" and c != "D" for (_, f), c in zip(rows, audit.replace("I", "")))


@pytest.mark.parametrize("n", [1000, 1001])
def test_ties_that_the_last_row_settles(n):
    """Of users only: which of two equally cheap strings is right depends on whether their number is odd."""
    cost, audit, _ = search([("user", None)] * n)
    assert cost == 3 * ((n + 1) // 2)
    assert audit == ("KR" * (n // 2) if n % 2 == 0 else "KI" + "KR" * (n // 2))
