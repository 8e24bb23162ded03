"""Conversation structure repair: the cheapest edits that make roles read ``(system)? (user assistant)*``.

A Viterbi search runs down each conversation with four states (nothing yet, after a system, a user,
an assistant row). The best edits of each state hang in a tree of backpointers with reference
counts: branches that no state needs are dropped at once, and when all states share their first
edits these are emitted and forgotten. What is held is the part still undecided, not the conversation.
Equal costs are settled by the whole undecided strings of edits; of two such strings only what
follows their common start is kept, up to the first letter in which they differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sqlcorpus.llm.tables import quoted

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3  # costs
NAMES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a row may become
LEGAL = frozenset(("su", "ua", "au"))
# WORSE[p][q]: how much more the rest can cost from p than from q, at most
WORSE = (
    (0, 0, 3, 0),
    (10, 0, 3, 6),
    (7, 3, 0, 3),
    (4, 0, 3, 0),
)
OUT_ROWS = 2000  # edits handed on together


class Node:
    """One edit, the edits that follow it on a live branch, and how many live ends or edits need it."""

    __slots__ = ("parent", "edit", "role", "row", "kids", "refs")

    def __init__(self, parent: Node | None, edit: str, role: str | None, row: tuple | None) -> None:
        self.parent, self.edit, self.role, self.row = parent, edit, role, row
        self.kids: list[Node] = []
        self.refs = 0
        if parent is not None:
            parent.kids.append(self)
            parent.refs += 1


def released(node: Node) -> None:
    """Drop a branch from its end up to where another one leaves it."""
    while node.refs == 0 and node.parent is not None:
        parent = node.parent
        parent.kids.remove(node)
        parent.refs -= 1
        node = parent


def difference(a: str, b: str) -> tuple[str, str]:
    """Both strings without their common start, cut after the first letter once they differ."""
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    return (a[0], b[0]) if a and b else (a, b)


class Survivors:
    """The best edits so far that end in each state."""

    def __init__(self) -> None:
        self.root = Node(None, "", None, None)
        self.cost: dict[int, int] = {START: 0}
        self.end = {START: self.root}
        self.apart = {(START, START): ("", "")}
        self.root.refs = 1
        self._move({START: [(0, START, ())]})

    def step(self, row: tuple, initial: str, must_go: bool, unfinished: bool) -> None:
        """Every way to go on with one row."""
        found: dict[int, list] = {}
        extra = UNFINISHED if unfinished else 0
        for state, cost in self.cost.items():
            found.setdefault(state, []).append((cost + DELETE, state, (("D", None, row),)))
            if must_go:
                continue
            to = AFTER[state]
            if initial == ("u" if to == USER else "a"):
                found.setdefault(to, []).append((cost + extra, state, (("K", row[1], row),)))
            else:
                found.setdefault(to, []).append((cost + ROLE + extra, state, (("R", NAMES[to], row),)))
            if state == START and initial == "s":
                found.setdefault(SYSTEM, []).append((cost + extra, state, (("K", row[1], row),)))
        self._move(found)

    def _less(self, x: tuple, y: tuple) -> bool:
        if x[0] != y[0]:
            return x[0] < y[0]
        a, b = self._difference(x, y)
        return a < b

    def _difference(self, x: tuple, y: tuple) -> tuple[str, str]:
        a, b = self.apart[x[1], y[1]]
        if a and b:  # decided before
            return a, b
        return difference(a + "".join(e[0] for e in x[2]), b + "".join(e[0] for e in y[2]))

    def _move(self, found: dict[int, list]) -> None:
        """Choose the best of each state, rows put in included, and let go of all other branches."""
        best: dict[int, tuple] = {}

        def offer(state: int, way: tuple) -> None:
            if state not in best or self._less(way, best[state]):
                best[state] = way

        for state, ways in found.items():
            for way in ways:
                offer(state, way)
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for state in sources:
                if state in best:
                    cost, old, edits = best[state]
                    offer(to, (cost + INSERT, old, (*edits, ("I", NAMES[to], None))))
        best = {q: w for q, w in best.items() if not any(o[0] + WORSE[p][q] < w[0] for p, o in best.items())}
        apart = {(p, q): self._difference(best[p], best[q]) for p in best for q in best}
        old_ends, self.end = self.end, {}
        for state, (_, old, edits) in best.items():
            node = old_ends[old]
            for edit, role, row in edits:  # an edit that another state has made already is shared
                node = next((k for k in node.kids if k.edit == edit and k.row is row), None) or Node(node, edit, role, row)
            node.refs += 1
            self.end[state] = node
        for node in old_ends.values():
            node.refs -= 1
            released(node)
        self.cost = {q: w[0] for q, w in best.items()}
        self.apart = apart

    def settled(self) -> Iterator[Node]:
        """Edits that all states share; they leave the tree."""
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root

    def finish(self) -> tuple[int, list[Node]]:
        """Cost of the best end that is allowed, and the edits not yet emitted."""
        ways = [(c, q, ()) for q, c in self.cost.items() if q in (START, ASSISTANT)]
        best = ways[0]
        for way in ways[1:]:
            if self._less(way, best):
                best = way
        node, out = self.end[best[1]], []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return best[0], out[::-1]


EDITS = pa.schema([
    ("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
    ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()), ("gap", pa.int64()), ("cost", pa.int64()),
])
EDITS_DDL = "conv_id long, seq long, edit string, turn long, role string, text string, fault string, illegal boolean, gap long, cost long"
SPACE = " \t\n\x0b\x0c\r"


def repaired_rows(rows: Iterator[dict]) -> Iterator[tuple]:
    """The edits of conversations whose rows follow each other in order.

    The last edit of each carries the cost of all; a conversation without edits is one row without an edit.
    """
    current: object = rows  # no conversation yet
    survivors = Survivors()
    seq, last_initial, last_turn, first = 0, None, None, True

    def emitted(nodes: Iterator[Node] | list[Node], conv: int | None) -> Iterator[tuple]:
        nonlocal seq
        for node in nodes:
            turn, role, text, fault, illegal, gap = node.row or (None, None, "", None, False, 0)
            yield conv, seq, node.edit, turn, node.role if node.edit != "D" else role, text, fault, illegal, gap, 0
            seq += 1

    def closed(held: list[tuple]) -> Iterator[tuple]:
        cost, nodes = survivors.finish()
        tail = held + list(emitted(nodes, current))
        if not tail:
            tail = [(current, 0, None, None, None, None, None, False, 0, 0)]
        yield from tail[:-1]
        yield (*tail[-1][:-1], cost)

    held: list[tuple] = []  # the last edit emitted, as the cost goes with the very last
    for row in rows:
        conv = row["conv_id"]
        if first or conv != current:
            if not first:
                yield from closed(held)
            current, survivors, held, first = conv, Survivors(), [], False
            seq, last_initial, last_turn = 0, None, None
        for copy in range(row["times"]):
            role, text, turn = row["role"], row["text"], row["turn"]
            initial, body = role[:1], text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if copy or row["again"] else "truncated" if body[-1] not in ".!?" else None
            illegal = last_initial is not None and last_initial + initial not in LEGAL
            gap = max(turn - last_turn - 1, 0) if turn is not None and last_turn is not None else 0
            last_initial, last_turn = initial, last_turn if turn is None else turn
            survivors.step((turn, role, text, fault, illegal, gap), initial, fault in ("blank", "duplicate"), fault == "truncated")
            for out in emitted(survivors.settled(), conv):
                yield from held
                held = [out]
    if not first:
        yield from closed(held)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == OUT_ROWS:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def repair_conversations(rows: DataFrame, times: str | None = None) -> DataFrame:
    """``conv_id``, ``seq``, ``edit``, ``turn``, ``role``, ``text``, ``fault``, ``illegal``, ``gap``, ``cost``: every edit, in order.

    Edits are K (keep), R (new role), D (delete) and I (insert an empty row); those but D, with their
    ``role`` and ``text``, are the repaired conversation. ``fault`` is a row's first of blank (no
    character but white space), duplicate (role and text seen earlier) and truncated (no closing
    mark); ``illegal`` tells that its role cannot follow the row before, ``gap`` how many turns are
    missing before it. ``cost`` stands in a conversation's last edit, 0 elsewhere. The cheapest edits
    are taken, of equal ones those whose letters come first.

    Rows are ordered by turn (null first), then role and text. ``times`` names a column that says how often a
    row stands (without it: once); 0 gives its conversation without the row. Null roles and texts
    are one blank; null ``conv_id`` is one more conversation. A conversation without rows gives one row
    without an edit; an empty table gives an empty one. Columns beside conv_id, turn, role and text
    are ignored, whatever their names. Equal rows are folded before they are shuffled, and each conversation
    streams through its task in sorted order: only the rows whose edits are undecided are held. (All of it can be
    undecided, if its last row settles a tie of the first.)
    """
    count = F.lit(1) if times is None else F.col(quoted(times))
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), count.cast("long").alias("times"))
    there = F.col("times") > 0
    # a row that does not stand is no earlier one either
    given = given.select("conv_id", *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")), "times")
    folded = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    spread = folded.repartition("conv_id")
    earlier = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    ordered = spread.select("*", earlier.alias("again")).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(repaired_rows(_dicts(batches)), EDITS)

    return ordered.mapInArrow(run, EDITS_DDL)


REPORT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
REPORT_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair_conversations``, in the order in which it gives them."""
    def told(rows: Iterator[dict]) -> Iterator[tuple]:
        conv: int | None = None
        audit: bytearray | None = None
        for row in rows:
            if audit is None or row["seq"] == 0:
                if audit is not None:
                    yield conv, gaps, *faults.values(), illegal, cost, audit.decode(), digest.hexdigest()
                conv, audit, digest, empty = row["conv_id"], bytearray(), hashlib.sha256(), True
                gaps = illegal = cost = 0
                faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            gaps, illegal, cost = gaps + row["gap"], illegal + row["illegal"], cost + row["cost"]
            if row["fault"]:
                faults[row["fault"]] += 1
            audit += (row["edit"] or "").encode()
            if row["edit"] in ("K", "R", "I"):
                digest.update((("" if empty else "\n") + row["role"] + ":" + row["text"]).encode())
                empty = False
        if audit is not None:
            yield conv, gaps, *faults.values(), illegal, cost, audit.decode(), digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(told(_dicts(batches)), REPORT)

    return edits.mapInArrow(run, REPORT_DDL)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of their place, and ``times``: how often each now stands."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))
