"""Conversation structure repair: the cheapest edits that give well-formed turns.

Well-formed roles read ``(s?(ua)+)?`` by their initials: an optional system
turn, then user and assistant in turn. A row may be kept (cost 0), given the
role user or assistant (1) or deleted (2); an empty user or assistant turn may
be inserted anywhere (5). Blank rows and rows seen before must go; a truncated
row that stays costs 5 more. Of the cheapest edits those whose initials (K, R,
D, I) come first in ASCII are taken.

Dijkstra's search runs on the implicit lattice of (row index, grammar state)
with the key (cost, audit), and stops at the first popped accepting end node.
Equal keys never meet in one node: the initials alone decide the states.

The rows are range-partitioned by conversation, turn, role and text, so one
conversation may spread over many tasks. A conversation that lies within one
range is searched whole. Others are searched in pieces of at most ``PIECE``
rows, from every entry state to every exit state, and the pieces' cheapest
paths are folded along the conversation: four live paths, told apart by cost
and by the order of their audits, which is kept as a rank and not as text.
Only the digest of one conversation is sequential, as digests are.

Defined cases: rows of equal turn are ordered by role, then text; null turns
come first; a null ``conv_id`` is a conversation of its own; null roles and
texts are one space; an empty role has no initial and cannot be kept; a gap
count beyond 64 bits is the largest long; an empty table gives no rows. Only
``conv_id``, ``turn``, ``role`` and ``text`` are read, so other columns may have
any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_to_batches

PIECE, PIECE_CHARS = 512, 4_000_000  # rows and code points of a piece
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by Rerole or Insert
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what takes a state to the nearest accepting one
LEGAL = {"su", "ua", "au"}
MOST = 2**63 - 1

Row = tuple[str, bool, bool]  # initial of the role, must go, truncated
_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_TURNS = "array<struct<role:string,text:string>>"
_PIECES = (
    f"conv_id long, part int, seq int, whole boolean, {_FIGURES}, entry int, audit string, first_turn long, last_turn long, n_turns long, has_turn boolean, "
    f"first_initial string, last_initial string, paths array<struct<entry:int,exit:int,cost:long,audit:string>>, turns {_TURNS}"
)
_TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIGURE_TYPES = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_PIECE_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *_FIGURE_TYPES, ("entry", pa.int32()), ("audit", pa.string()),
        ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("has_turn", pa.bool_()), ("first_initial", pa.string()), ("last_initial", pa.string()),
        ("paths", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("turns", _TURN_TYPE),
    ]
)


# ---- the search ----
def _popped(rows: list[Row], entry: int, ending: bool) -> Iterator[tuple[int, str, int]]:
    """``(cost, audit, state)`` of the end nodes in the order in which the search pops them.

    Without ``ending`` nothing is inserted after the last row, so that pieces do not insert twice in one place.
    """
    heap, done = [(0, "", 0, entry)], set()
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            yield cost, audit, state
        if i < len(rows) or ending:
            heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state]))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                stays = cost + TRUNCATED * truncated
                heappush(heap, (stays + REROLE, audit + "R", i + 1, NEXT[state]))
                if (state, initial) in KEPT:
                    heappush(heap, (stays, audit + "K", i + 1, KEPT[state, initial]))


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return next((cost, audit) for cost, audit, state in _popped(rows, START, True) if not ENDING[state])


def edited(turns: Iterable[dict], entry: int, audit: str) -> list[dict]:
    """The rows after the edits of an audit, begun in the state ``entry``."""
    rows, state, out = iter(turns), entry, []
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state, row["role"][:1]]
            out.append({"role": row["role"], "text": row["text"]})
        else:
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": "" if row is None else row["text"]})
    return out


def _fold(pieces: Iterable[dict]) -> tuple[dict, list[tuple[int, int, int, str]]]:
    """Figures of a conversation in pieces, and ``(part, seq, entry, audit)`` of each piece."""
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    live, turns, low, high, last = {START: (0, 0, None)}, 0, None, None, None  # state: cost, rank of the audit, pieces so far
    for p in pieces:
        for k in total:
            total[k] += p[k]
        if last is not None and last + p["first_initial"] not in LEGAL:
            total["illegal"] += 1
        last = p["last_initial"]
        if p["has_turn"]:
            low = p["first_turn"] if low is None else low
            turns += p["n_turns"] - (high == p["first_turn"])
            high = p["last_turn"]
        best: dict[int, tuple] = {}
        for path in p["paths"]:
            if path["entry"] in live:
                cost, rank, before = live[path["entry"]]
                key = (cost + path["cost"], rank, path["audit"])
                if path["exit"] not in best or key < best[path["exit"]][0]:
                    best[path["exit"]] = key, (before, (p["part"], p["seq"], path["entry"], path["audit"]))
        order = sorted(best, key=lambda s: best[s][0][1:])
        live = {s: (best[s][0][0], rank, best[s][1]) for rank, s in enumerate(order)}
    cost, _, tail, path = min((cost + INSERT * len(ENDING[s]), rank, ENDING[s], path) for s, (cost, rank, path) in live.items())
    chosen = []
    while path is not None:
        path, (part, seq, entry, audit) = path
        chosen.append((part, seq, entry, audit + tail))
        tail = ""
    return {"gaps": 0 if low is None else min(MOST, high - low + 1 - turns), **total, "cost": cost}, chosen[::-1]


# ---- pieces ----
class _Piece:
    """A run of rows of one conversation."""

    def __init__(self, conv: int | None, seq: int):
        self.conv, self.seq, self.rows, self.turns, self.chars = conv, seq, [], [], 0
        self.faults, self.illegal, self.first, self.last, self.n_turns = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, None, 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        end = text.rstrip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if seen else "truncated" if end not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        if self.rows and self.rows[-1][0] + role[:1] not in LEGAL:
            self.illegal += 1
        self.rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.turns.append({"role": role, "text": text})
        self.chars += len(text)
        if turn is not None:
            self.n_turns += self.n_turns == 0 or turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= PIECE_CHARS

    def row(self, part: int, whole: bool) -> tuple:
        if whole:
            (cost, audit), paths = cheapest(self.rows), []
            gaps = 0 if self.first is None else min(MOST, self.last - self.first + 1 - self.n_turns)
        else:
            gaps, cost, audit = None, None, None
            paths = [{"entry": a, "exit": b, "cost": c, "audit": x} for a in STATES for c, x, b in _popped(self.rows, a, False)]
        return (
            self.conv, part, self.seq, whole, gaps, *self.faults.values(), self.illegal, cost, START if whole else None, audit, self.first, self.last, self.n_turns,
            self.first is not None, self.rows[0][0], self.rows[-1][0], paths, self.turns,
        )


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Pieces of rows sorted by conversation; one is whole if its conversation begins and ends inside this range."""
    part, open_, before, first = TaskContext.get().partitionId(), None, None, True
    for b in batches:
        for conv, turn, role, text, later in zip(*(c.to_pylist() for c in b.columns)):
            if open_ is not None and (conv != open_.conv or open_.full(size)):
                yield open_.row(part, not first and conv != open_.conv and open_.seq == 0)
                first = first and conv == open_.conv
                open_ = _Piece(conv, open_.seq + 1 if conv == open_.conv else 0)
            elif open_ is None:
                open_ = _Piece(conv, 0)
            same = (conv, turn, role, text)
            open_.add(turn, role, text, later or same == before)
            before = same
    if open_ is not None:
        yield open_.row(part, False)


def _turn_key() -> Column:
    """Orders turns with nulls first."""
    return F.struct(F.col("turn").isNotNull(), F.col("turn"))


def _pieces(turns: DataFrame, size: int) -> DataFrame:
    blank = F.lit(" ")
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    t = t.withColumn("same", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))
    # role and text that come more than once, with their first turn; equal rows of one turn meet in the stream
    more = t.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.count("*").alias("n"), F.min(_turn_key()).alias("earliest")).where("n > 1")
    seen = t.join(more, t["conv_id"].eqNullSafe(more["c"]) & (t["same"] == more["s"]), "left")
    rows = seen.select("conv_id", "turn", "role", "text", F.coalesce(_turn_key() > F.col("earliest"), F.lit(False)).alias("later"))
    key = ["conv_id", "turn", "role", "text"]
    return checkpointed(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(lambda it: rows_to_batches(_cut(it, size), _PIECE_SCHEMA, 200), _PIECES))


def _folded(pieces: DataFrame) -> DataFrame:
    """A row per piece of the conversations in several: ``entry`` and ``audit``; the first one has the figures."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32()), ("audit", pa.string()), ("head", pa.bool_()), *_FIGURE_TYPES])

    def run(batches):
        def rows():
            stream = (r for b in batches for at in range(0, b.num_rows, 200) for r in b.slice(at, 200).to_pylist())
            ahead = next(stream, None)

            def one(conv):
                nonlocal ahead
                while ahead is not None and ahead["conv_id"] == conv:
                    yield ahead
                    ahead = next(stream, None)

            while ahead is not None:
                conv = ahead["conv_id"]
                figures, chosen = _fold(one(conv))
                for k, (part, seq, entry, audit) in enumerate(chosen):
                    yield conv, part, seq, entry, audit, k == 0, *(figures.values() if k == 0 else [None] * 6)

        return rows_to_batches(rows(), schema, 1_000)

    slim = pieces.where("not whole").drop("turns")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, f"conv_id long, part int, seq int, entry int, audit string, head boolean, {_FIGURES}")


def repair(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv_id, part, seq, whole, head, entry, audit, repaired`` and figures, a row per piece of a conversation.

    ``repaired`` holds the piece's turns after the edits, in order of ``part``
    and ``seq``. The figures (gaps, blank, duplicate, truncated, illegal, cost)
    are those of the whole conversation, in its first piece (``head``).
    """
    pieces = _pieces(turns, piece)
    figures = [n for n, _ in _FIGURE_TYPES]
    whole = pieces.where("whole").select("conv_id", "part", "seq", "whole", F.lit(True).alias("head"), *figures, "entry", "audit", "turns")
    f, p = _folded(pieces), pieces.where("not whole").select("part", "seq", "whole", "turns", F.col("conv_id").alias("c"))
    split = p.join(f, ["part", "seq"]).where(F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", "part", "seq", "whole", "head", *figures, "entry", "audit", "turns")
    both = whole.unionByName(split)
    schema = pa.schema([*((n, t) for n, t in (("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("head", pa.bool_()))), *_FIGURE_TYPES, ("entry", pa.int32()), ("audit", pa.string()), ("repaired", _TURN_TYPE)])

    def run(batches):
        rows = (r for b in batches for at in range(0, b.num_rows, 200) for r in zip(*(c.to_pylist() for c in b.slice(at, 200).columns)))
        return rows_to_batches(((*r[:-1], edited(r[-1], r[-3], r[-2])) for r in rows), schema, 200)

    return both.mapInArrow(run, f"conv_id long, part int, seq int, whole boolean, head boolean, {_FIGURES}, entry int, audit string, repaired {_TURNS}")


def repaired_turns(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv_id, part, seq, pos, role, text``: the turns after repair, ordered by ``part``, ``seq`` and ``pos``."""
    return repair(turns, piece).select("conv_id", "part", "seq", F.posexplode("repaired").alias("pos", "turn")).select("conv_id", "part", "seq", "pos", "turn.role", "turn.text")


# ---- the report ----
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the hash of ``conv_id:turn``: one in 20 each dropped, emptied, without ``.!?``, repeated, made a user's."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    t = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), "kind")
    return t.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _digests(split: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of conversations in several pieces, streamed a piece at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("all_audit", pa.string()), ("all_sha256", pa.string())])

    def run(batches):
        def rows():
            conv, audit, digest, empty = None, None, None, True
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    for c, letters, turns in zip(*(x.to_pylist() for x in b.slice(at, 200).select(["conv_id", "audit", "repaired"]).columns)):
                        if audit is None or c != conv:
                            if audit is not None:
                                yield conv, "".join(audit), digest.hexdigest()
                            conv, audit, digest, empty = c, [], hashlib.sha256(), True
                        audit.append(letters)
                        for t in turns:
                            digest.update(("" if empty else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                            empty = False
            if audit is not None:
                yield conv, "".join(audit), digest.hexdigest()

        return rows_to_batches(rows(), schema)

    ordered = split.select("conv_id", "part", "seq", "audit", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(run, "conv_id long, all_audit string, all_sha256 string")


def repair_report(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Damages all conversations, repairs them and digests the result; one row per original ``conv_id``."""
    r = checkpointed(repair(damaged(conversations), piece))
    figures = [n for n, _ in _FIGURE_TYPES]
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = r.where("whole").select("conv_id", *figures, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    heads, d = r.where("not whole and head").select("conv_id", *figures), _digests(r.where("not whole")).withColumnRenamed("conv_id", "c")
    split = heads.join(d, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *figures, F.col("all_audit").alias("audit"), F.col("all_sha256").alias("repaired_sha256"))
    found = whole.unionByName(split).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    zero, nothing = F.lit(0).cast("long"), F.lit(hashlib.sha256().hexdigest())
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *(F.coalesce(n, zero).alias(n) for n in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
