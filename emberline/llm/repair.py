"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, by Knuth's lightest derivations.

A repair item says that so many turns are read and where in the pattern the repaired roles stand. Edits are weighted
deductions from item to item; a weight is (cost, audit), the audit being the edits' initials, and deductions only add to
it, so items popped in order of weight are final (Knuth 1977), and so is the repair once the goal is.

Turns are judged and repaired without their texts: rows of hashes are sorted by conversation and turn over as many tasks
as there are rows for, whatever their conversations. A task repairs its stretch of a conversation, block by block, from
each place in the pattern where it may begin (only the first of a task's conversations has more than one) to each where
it may end; the stretches' ends then meet. Texts move once, to the repaired turns. A digest of all of a conversation's
text is a chain of bytes, so one task reads these, as a stream, and holds one batch.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .memory import let_go

BLOCK = 64  # turns that one agenda reads
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1  # what an undeleted truncated turn adds
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role of what stands so far
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}  # the role that an inserted or reroled turn must have
MISSING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # turns to insert at the end
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def lightest(axioms: list[tuple], deduce: Callable, goal=None) -> dict:
    """Weights of items in the order in which they are final, up to ``goal`` if there is one.

    ``axioms`` are (weight, item); ``deduce(item, weight)`` gives the (weight, item) that follow, none lighter than ``weight``.
    """
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            break
        for more in deduce(item, weight):
            if more[1] not in final:
                heapq.heappush(agenda, more)
    return final


GOAL = (-1, 0, 0)


def repairs(turns: list[tuple[str, bool, bool]], start: int, whole: bool) -> dict:
    """Lightest repairs of (initial, must go, truncated) turns from a place in the pattern, by place where they end.

    Turns are inserted before a turn, so repairs that end at different places never begin alike. With ``whole``, the
    conversation ends here: insertions after the last turn count, and the only key is the goal.
    """
    n = len(turns)

    def deduce(item, weight):
        i, at, _ = item
        cost, audit = weight
        if i == n and whole and at in (START, ASSISTANT):
            yield weight, GOAL
        if i < n or whole:
            yield (cost + INSERT[1], audit + INSERT[0]), (i, STEPS[at, NEXT[at]], 1)
        if i < n:
            initial, must_go, truncated = turns[i]
            yield (cost + DELETE[1], audit + DELETE[0]), (i + 1, at, 0)
            if not must_go:
                cost += TRUNCATED if truncated else 0
                yield (cost + REROLE[1], audit + REROLE[0]), (i + 1, STEPS[at, NEXT[at]], 0)
                if (at, initial) in STEPS:
                    yield (cost + KEEP[1], audit + KEEP[0]), (i + 1, STEPS[at, initial], 0)

    final = lightest([((0, ""), (0, start, 0))], deduce, GOAL if whole else None)
    if whole:
        return {GOAL: final[GOAL]}
    return {at: final[n, at, 0] for at in range(4) if (n, at, 0) in final}


class Stretch:
    """A conversation's turns within one task, folded block by block: the best repair from each start to each end."""

    def __init__(self, conv, key: tuple, starts: tuple):
        self.conv, self.key, self.starts = conv, key, starts
        self.best = {p: {p: (0, 0, None)} for p in starts}  # start: {end: (cost, rank of the audit, audit's parts)}
        self.turns: list[tuple] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.distinct, self.folded = 0, False

    def add(self, initial: str, blank: bool, first: bool, truncated: bool, copies: int, turn) -> None:
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += copies - 1  # no role may follow itself
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        fault = "blank" if blank else None if first else "duplicate"
        if fault:
            self.counts[fault] += 1
        elif truncated:
            self.counts["truncated"] += 1
        self.turns.append((initial, fault is not None, truncated))
        if copies > 1:
            self.counts["blank" if blank else "duplicate"] += copies - 1
            self.fold()
            self.extend({p: {p: ((copies - 1) * DELETE[1], DELETE[0] * (copies - 1))} for p in range(4)})
        if len(self.turns) >= BLOCK:
            self.fold()

    def fold(self) -> None:
        if self.turns:
            self.extend({p: repairs(self.turns, p, False) for p in {q for ends in self.best.values() for q in ends}})
            self.turns = []

    def extend(self, block: dict) -> None:
        """Go on with a block's repairs. Audits up to here rank by their order, for none is the beginning of another."""
        self.folded = True
        for p, ends in self.best.items():
            found: dict = {}
            for q, (cost, rank, parts) in ends.items():
                for r, (more, audit) in block[q].items():
                    option = (cost + more, rank, audit, parts)
                    if r not in found or option[:3] < found[r][:3]:
                        found[r] = option
            order = sorted(found, key=lambda r: found[r][1:3])
            self.best[p] = {r: (found[r][0], order.index(r), (found[r][3], found[r][2])) for r in found}

    def row(self, ended: bool) -> tuple:
        goal = None
        if ended and not self.folded:
            goal = repairs(self.turns, START, True)[GOAL]
        else:
            self.fold()
        ways = [] if goal else [{"p": p, "q": q, "cost": cost, "rank": rank, "audit": _text(parts)} for p, ends in self.best.items() for q, (cost, rank, parts) in ends.items()]
        if goal:
            ways = [{"p": START, "q": -1, "cost": goal[0], "rank": 0, "audit": goal[1]}]
        return (self.conv, *self.key, *self.counts.values(), self.first, self.last, self.low, self.high, self.distinct, ways)


def _text(parts) -> str:
    out = []
    while parts:
        parts, audit = parts
        out.append(audit)
    return "".join(reversed(out))


ROW = (
    "conv_id long, turn long, role string, h1 long, h2 int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long, "
    "ways array<struct<p: int, q: int, cost: long, rank: int, audit: string>>"
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_WAYS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ways ")[0].split(", ")]
    kinds = [_KINDS[k] for _, k in fields] + ([_WAYS] if ", ways " in schema else [])
    names = [n for n, _ in fields] + (["ways"] if ", ways " in schema else [])
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, h1, h2, initial, blank, first, cut, copies) in order to a row a conversation of this task."""
    let_go()
    now, done = None, []
    for batch in batches:
        for conv, turn, role, h1, h2, *judged in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.row(ended=len(now.starts) == 1))
                now = Stretch(conv, (turn, role, h1, h2), tuple(range(4)) if now is None else (START,))
            now.add(*judged, turn)
        if len(done) > 1000:
            yield _batch(done, ROW)
            done = []
    if now is not None:
        done.append(now.row(ended=False))
    yield _batch(done, ROW)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order to a report a conversation."""
    let_go()

    def report(parts: list[dict]) -> tuple:
        first, last = parts[0], parts[-1]
        counts = {c: sum(p[c] for p in parts) for c in COUNTS}
        counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
        known = [p for p in parts if p["low"] is not None]
        distinct = sum(p["distinct"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        if last["ways"][0]["q"] == -1:  # the whole conversation was in one task
            cost, audit = last["ways"][0]["cost"], last["ways"][0]["audit"]
        else:
            all_ = Stretch(first["conv_id"], (), (START,))
            for p in parts:
                block: dict = {q: {} for q in range(4)}
                for w in p["ways"]:
                    block[w["p"]][w["q"]] = (w["cost"], w["audit"])
                all_.extend(block)
            cost, _, parts_, missing = min((cost + MISSING[q] * INSERT[1], rank, parts_, MISSING[q]) for q, (cost, rank, parts_) in all_.best[START].items())
            audit = _text(parts_) + INSERT[0] * missing
        return (first["conv_id"], gaps, *(counts[c] for c in COUNTS), cost, audit)

    parts: list[dict] = []
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if parts and row["conv_id"] != parts[0]["conv_id"]:
                done.append(report(parts))
                parts = []
            parts.append(row)
        yield _batch(done, REPORT)
    if parts:
        yield _batch([report(parts)], REPORT)


def _plain(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))


def _reports(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    key = ["conv_id", "turn", "role", "h1", "h2"]
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    judged = rows.select(*key, (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    same = scratch.keep(judged.groupBy(*key).agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("copies")), "turns")
    seen = same.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("seen"))
    x, y = same.alias("x"), seen.alias("y")
    equal: Column = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.role") == F.col("y.role")) & (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2"))
    first = F.col("x.turn").eqNullSafe(F.col("y.seen.turn"))
    facts = x.join(y, equal).select(*(f"x.{c}" for c in key), F.substring("x.role", 1, 1).alias("initial"), "x.blank", first.alias("first"), "x.cut", "x.copies")
    stretches = facts.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_stretches, ROW)
    found = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h1", "h2").mapInArrow(_joined, REPORT)
    made = ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zero = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return scratch.keep(made.select("i.conv_id", *zero, F.coalesce("f.audit", F.lit("")).alias("audit")), "reports")


def _edited(rows: DataFrame, reports: DataFrame, digest: bool) -> DataFrame:
    """The repaired turns of every conversation, or their digest."""
    names = [f.split(" ")[0] for f in REPORT.split(", ")][1:]
    heads = reports.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("h1", "long"), ("h2", "int"), ("text", "string"))), *names)
    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "text", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in names))
    order = ["conv_id", "kind", "turn", "role", "h1", "h2"]
    out_schema = f"{REPORT}, repaired_sha256 string" if digest else "conv_id long, place long, turn long, role string, text string, edit string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        head, out = None, []
        audit, at, place, state, sha = "", 0, 0, START, hashlib.sha256()

        def put(turn, role, text, edit):
            nonlocal place, state
            state = STEPS[state, role[:1]]
            if digest:
                sha.update((("\n" if place else "") + role + ":" + text).encode())
            else:
                out.append((head[0], place, turn, role, text, edit))
            place += 1

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(None, NAMES[NEXT[state]], "", "I")
                at += 1

        def close():
            if head is not None:
                inserted()
                if digest:
                    out.append((*head, sha.hexdigest()))

        for batch in batches:
            for conv, kind, turn, role, _, _, text, *report in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    close()
                    head, audit = (conv, *report), report[-1]
                    at, place, state, sha = 0, 0, START, hashlib.sha256()
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(turn, NAMES[NEXT[state]] if edit == "R" else role, text, edit)
            yield _batch(out, out_schema)
            out.clear()
        close()
        yield _batch(out, out_schema)

    return heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(apply, out_schema)


def _prepared(turns: DataFrame, ids: DataFrame | None, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(turns.sparkSession, "repair")
    rows = _plain(turns, *columns)
    ids = rows.select("conv_id").distinct() if ids is None else ids
    return rows, _reports(rows, ids, scratch)


def repair_report(turns: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults and cheapest repair of every conversation, with a digest of the repaired turns.

    A conversation's turns stand by number (nulls first), of equal numbers by role, then by hashes of the text; rows equal
    in all are interchangeable. Null roles and texts are one blank; turns without an id are one conversation. Each
    turn's first fault counts: ``blank`` (white space only), ``duplicate`` (role and text stood before), ``truncated``
    (the last visible character is none of ``. ! ?``). ``gaps`` are numbers missing between the smallest and largest,
    ``illegal`` neighbours' role initials other than su, ua, au. Edits: Keep 0, Rerole to user or assistant 2, Delete 3
    (the only one for blank and duplicate turns), Insert an empty user or assistant turn anywhere 2; a truncated turn that
    stays adds 1. ``audit`` are the initials of the cheapest edits (of those the first in ASCII order) that give the initials
    ``(s?(ua)+)?``; an initial is the role's first character, so any role that begins with s, u or a stands for it.
    ``repaired_sha256`` is of ``role:text`` lines joined by line feeds. ``ids`` (``conv_id``, distinct) lists conversations
    to report even if they have no turns: zeros, an empty audit, the digest of nothing. Other columns play no part.
    """
    rows, reports = _prepared(turns, ids, (id_col, turn_col, role_col, text_col))
    return _edited(rows, reports, digest=True)


def repaired_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns that stay, reroled or inserted: ``conv_id``, ``place`` (from 0), ``turn``, ``role``, ``text``, ``edit``.

    Rules as for :func:`repair_report`; ``turn`` is the number before repair, null for inserted turns.
    """
    rows, reports = _prepared(turns, None, (id_col, turn_col, role_col, text_col))
    return _edited(rows, reports, digest=False)


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults put in by crc32 of ``id:turn`` modulo 20: ``conv_id``, ``turn``, ``role``, ``text``.

    0 drops the turn, 1 empties its text, 2 takes out its ``. ! ?``, 3 repeats it, 4 makes its role ``user``. Null ids and
    turns count as one blank there and stay null; null roles and texts become one blank.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    role, text = (F.coalesce(F.col(c), blank) for c in (role_col, text_col))
    fault = F.crc32(name.cast("binary")) % 20
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("array_repeat(0, if(fault = 3, 2, 1))")).alias("copy")).drop("copy")
