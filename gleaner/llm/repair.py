"""Conversation structure repair by scalar big-integer weights.

The rows of a conversation, ordered by turn (nulls first), then role and text, are edited at least cost until
their role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an
empty user or assistant row 3, and a truncated row that is not deleted 3 more. Blank rows and duplicates must go.
The audit is the initials of the edits in order; of equally cheap repairs the one with the ASCII-least audit wins.

Weights are single integers. Their high digits carry the cost, their low digits, of three bits each, are
the letters of the audit at fixed places from the left (D 1, I 2, K 3, R 4; places beyond its end are zero), so
an integer minimum compares cost first and audits next. The nodes of the DAG are (row, state), with the states
"nothing yet", "after s", "after u" and "after a"; an edge adds a digit at the next place and its cost. Two paths
to one node never tie with one audit the beginning of the other: what the longer one had more would be inserted
rows, which cost. So the minimum of a prefix stays the minimum whatever follows, and a conversation may be cut: a
block of ``BLOCK`` rows becomes its least weights from each state to each state, and blocks are chained by the
same minimum. No conversation is ever collected; its edits are rows. Only ``audit``, where it is asked for as one
value, and the SHA-256 of a repaired conversation need one task that reads the conversation in order, which
streams it.

Roles of a repaired row follow from the state and the letter, since an inserted or reroled row can only be what
the pattern needs next.

Defined cases: a null role or text is one space; a row's initial is the first character of its role, so an empty
role has none and cannot be kept; identical rows of one turn are adjacent and all but the first are duplicates;
a null conv_id is a conversation of its own; a conversation without rows is repaired already; texts may have any
length, only their last characters are looked at; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: rows that become one block; a bin of blocks is one group
BLOCK = 1024
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

_BITS = 3
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTERS = str.maketrans("1234", "DIKR")
_DIGITS = str.maketrans("DIKR", "1234")
#: what may follow in each state, and where it leads; states are 0 nothing yet, 1 after s, 2 after u, 3 after a
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: what a reroled or inserted row becomes in each state
_FORCED = ["u", "u", "a", "u"]
_ROLE = {"u": "user", "a": "assistant"}
_ACCEPTED = (0, 3)

_ORDERED = "conv_id long, turn long, role string, text string, n long, seen boolean, pos long, block long, bin long, starts boolean"
_BLOCKS = (
    "conv_id long, block long, bin long, blank long, duplicate long, truncated long, illegal long, first_role string, "
    "last_role string, low_turn long, high_turn long, turns long, paths array<struct<q:int,to:int,cost:long,audit:string>>"
)
_CHAINED = (
    "conv_id long, block long, bin long, q int, audit string, cost long, gaps long, blank long, duplicate long, "
    "truncated long, illegal long"
)
_EDITS = "conv_id long, block long, place long, edit string, role string, text string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    paths = pa.list_(pa.struct([("q", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.schema([(name, kinds.get(kind, paths)) for name, kind in (f.split(" ", 1) for f in ddl.split(", "))])


def judge(role: str, text: str, n: int, seen: bool) -> tuple[str | None, int, int, int, int, int]:
    """What ``n`` identical rows are: the initial of the one that may stay (None: all must go), the cost of not
    deleting it, rows to delete besides it, and how many are blank, duplicate and truncated."""
    rest = text.rstrip(SPACE)
    if not rest:
        return None, 0, n, n, 0, 0
    if seen:
        return None, 0, n, 0, n, 0
    cut = rest[-1] not in ".!?"
    return role[:1], TRUNCATED * cut, n - 1, 0, n - 1, int(cut)


def _inserted(at: list, digits: int) -> None:
    """Relax the edges that insert a row; a state is never left and reached again, so three rounds do."""
    for _ in range(3):
        for q, known in enumerate(at):
            if known is not None:
                _offer(at, _NEXT[q][_FORCED[q]], *_step(known, INSERT, "I", digits))


def _step(known: tuple[int, int], cost: int, letter: str, digits: int) -> tuple[int, int]:
    weight, length = known
    return weight + (cost << _BITS * digits) + (_DIGIT[letter] << _BITS * (digits - 1 - length)), length + 1


def _offer(at: list, q: int, weight: int, length: int) -> None:
    if at[q] is None or weight < at[q][0]:
        at[q] = (weight, length)


def least_weights(rows: list[tuple[str | None, int, int]], start: int) -> list[tuple[int, str] | None]:
    """From state ``start``, through rows of (initial or None, cost of not deleting, further rows to delete):
    the least (cost, audit) that leads to each state."""
    digits = 2 * sum(extra + 1 for _, _, extra in rows) + 4
    at: list = [None] * 4
    at[start] = (0, 0)
    _inserted(at, digits)
    for initial, cost, extra in rows:
        now: list = [None] * 4
        for q, known in enumerate(at):
            if known is None or initial is None:
                continue
            _offer(now, q, *_step(known, DELETE, "D", digits))
            if initial in _NEXT[q]:
                _offer(now, _NEXT[q][initial], *_step(known, cost, "K", digits))
            if initial != _FORCED[q]:
                _offer(now, _NEXT[q][_FORCED[q]], *_step(known, REROLE + cost, "R", digits))
        if initial is not None:
            _inserted(now, digits)
            at = now
        if extra:  # a run of D at once; rows may still be inserted before the last of them
            if extra > 1:
                run = ((1 << _BITS * (extra - 1)) - 1) // ((1 << _BITS) - 1)
                shift = digits - extra + 1
                at = [k and (k[0] + (DELETE * (extra - 1) << _BITS * digits) + (run << _BITS * (shift - k[1])), k[1] + extra - 1) for k in at]
            at = [k and _step(k, DELETE, "D", digits) for k in at]
            _inserted(at, digits)
    low = (1 << _BITS * digits) - 1
    return [k and (k[0] >> _BITS * digits, format((k[0] & low) >> _BITS * (digits - k[1]), "o").translate(_LETTERS) if k[1] else "") for k in at]


def replay(rows: list[tuple[str, str, int]], audit: str, q: int) -> Iterator[tuple[str, str | None, str | None]]:
    """The edits of ``audit`` from state ``q`` over rows of (role, text, copies): (letter, role, text), role and
    text as they are after it, null for a deleted row."""
    left = iter([(role, text) for role, text, n in rows for _ in range(n)])
    for letter in audit:
        role, text = next(left) if letter != "I" else (None, "")
        if letter == "D":
            yield letter, None, None
            continue
        initial = role[:1] if letter == "K" else _FORCED[q]
        yield letter, role if letter == "K" else _ROLE[initial], text
        q = _NEXT[q][initial]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over sorted rows: places, and the blocks and bins that hold them."""
    pos = TaskContext.get().partitionId() << 33
    nothing = object()
    conv, block, bin_, starts, size = nothing, pos, pos, False, 0
    for batch in batches:
        out: dict[str, list] = {"pos": [], "block": [], "bin": [], "starts": []}
        for own in batch.column("conv_id").to_pylist():
            fresh = own != conv or conv is nothing
            if fresh or pos - block >= BLOCK:
                # what a partition begins with may go on from the one before
                starts, conv, block = fresh and conv is not nothing, own, pos
                if pos - bin_ >= BLOCK:
                    bin_ = pos
            for name, value in zip(out, (pos, block, bin_, starts)):
                out[name].append(value)
            pos += 1
        added = [pa.array(out["pos"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["bin"], pa.int64()), pa.array(out["starts"], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema=_schema(_ORDERED))


def _by_block(table: pa.Table) -> Iterator[list[dict]]:
    """The rows of each block of a bin, in order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
    at = 0
    while at < len(rows):
        to = at
        while to < len(rows) and rows[to]["block"] == rows[at]["block"]:
            to += 1
        yield rows[at:to]
        at = to


def _transfers(table: pa.Table) -> pa.Table:
    """applyInArrow by bin: counts and least weights of each block."""
    out = []
    for rows in _by_block(table):
        judged = [judge(r["role"], r["text"], r["n"], r["seen"]) for r in rows]
        items = [j[:3] for j in judged]
        paths = []
        for q in (0,) if rows[0]["starts"] else range(4):
            for to, found in enumerate(least_weights(items, q)):
                if found is not None:
                    paths.append({"q": q, "to": to, "cost": found[0], "audit": found[1]})
        illegal, before = 0, None
        for r in rows:
            own = r["role"][:1]
            illegal += (before is not None and before + own not in LEGAL) + (r["n"] - 1)
            before = own
        turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
        first = rows[0]
        out.append({
            "conv_id": first["conv_id"], "block": first["block"], "bin": first["bin"],
            "blank": sum(j[3] for j in judged), "duplicate": sum(j[4] for j in judged), "truncated": sum(j[5] for j in judged),
            "illegal": illegal, "first_role": first["role"][:1], "last_role": before,
            "low_turn": turns[0] if turns else None, "high_turn": turns[-1] if turns else None, "turns": len(turns), "paths": paths,
        })
    return pa.Table.from_pylist(out, schema=_schema(_BLOCKS))


class _Chain:
    """Blocks of one conversation, met in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        #: state: (cost, digits, their number, path as (rest, block, bin, q, audit))
        self.at: dict[int, tuple[int, int, int, tuple | None]] = {0: (0, 0, 0, None)}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.role = self.low = self.high = None
        self.turns = 0

    def add(self, row: dict) -> None:
        paths = [(p, self.at[p["q"]]) for p in row["paths"] if p["q"] in self.at]
        digits = max(known[2] + len(p["audit"]) for p, known in paths)
        least: dict[int, tuple] = {}
        for p, (cost, low, length, path) in paths:
            n = len(p["audit"])
            low = low << _BITS * n | int("0" + p["audit"].translate(_DIGITS), 8)
            weight = (cost + p["cost"] << _BITS * digits) + (low << _BITS * (digits - length - n))
            if p["to"] not in least or weight < least[p["to"]][0]:
                least[p["to"]] = (weight, (cost + p["cost"], low, length + n, (path, row["block"], row["bin"], p["q"], p["audit"])))
        self.at = {to: known for to, (_, known) in least.items()}
        for name in self.counts:
            self.counts[name] += row[name]
        if self.role is not None and self.role + row["first_role"] not in LEGAL:
            self.counts["illegal"] += 1
        self.role = row["last_role"]
        if row["low_turn"] is not None:
            self.turns += row["turns"] - (self.high == row["low_turn"])
            self.low = row["low_turn"] if self.low is None else self.low
            self.high = row["high_turn"]

    def rows(self) -> Iterator[dict]:
        """The summary, which has no block, and the part of each block."""
        ends = [self.at[q] for q in _ACCEPTED if q in self.at]
        digits = max(known[2] for known in ends)
        cost, low, length, path = min(ends, key=lambda k: (k[0] << _BITS * digits) + (k[1] << _BITS * (digits - k[2])))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        audit = format(low, "o").translate(_LETTERS) if length else ""
        yield {"conv_id": self.conv_id, "block": None, "audit": audit, "cost": cost, "gaps": gaps, **self.counts}
        while path is not None:
            path, block, bin_, q, part = path
            yield {"conv_id": self.conv_id, "block": block, "bin": bin_, "q": q, "audit": part}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over blocks sorted by conversation and place: summaries and the parts of blocks."""
    schema, chain = _schema(_CHAINED), None
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if chain is None or chain.conv_id != row["conv_id"]:
                out += chain.rows() if chain is not None else []
                chain = _Chain(row["conv_id"])
            chain.add(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if chain is not None:
        yield pa.RecordBatch.from_pylist(list(chain.rows()), schema=schema)


def _edited(table: pa.Table, parts: pa.Table) -> pa.Table:
    """Cogrouped by bin: the edits of every row of its blocks, in order."""
    chosen = {p["block"]: p for p in parts.to_pylist()}
    out = []
    for rows in _by_block(table):
        part = chosen[rows[0]["block"]]
        edits = replay([(r["role"], r["text"], r["n"]) for r in rows], part["audit"], part["q"])
        for place, (letter, role, text) in enumerate(edits):
            out.append({"conv_id": rows[0]["conv_id"], "block": rows[0]["block"], "place": place, "edit": letter, "role": role, "text": text})
    return pa.Table.from_pylist(out, schema=_schema(_EDITS))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over repaired rows sorted by conversation and place: the digest of each conversation."""
    nothing = object()
    conv, state = nothing, None

    def told(ids: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": pa.array(digests, pa.string())})

    for batch in batches:
        ids, digests = [], []
        for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv is nothing or own != conv:
                if conv is not nothing:
                    ids.append(conv)
                    digests.append(state.hexdigest())
                conv, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield told(ids, digests)
    if conv is not nothing:
        yield told([conv], [state.hexdigest()])


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by ``crc32(conv_id:turn) % 20``; nulls are one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hit = F.col("_hit")
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_hit"))
        .filter(hit != 0)
        .select(
            F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"), "conv_id", "turn",
            F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(hit == 1, F.lit("")).when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        )
        .drop("_copy")
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Identical rows as one with their number, in order, marked where role and text stood in an earlier turn."""
    same = materialize(
        rows.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        ).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")),
        "repair-rows",
    )
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_key")
    since = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    firsts = same.select("conv_id", key, since.alias("_at")).groupBy("conv_id", "_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_times"))
    # most texts stand once; those that do not are looked up by their rows alone
    repeated = firsts.filter("_times > 1").select(F.col("conv_id").alias("_conv"), F.col("_key").alias("_same"), "_first")
    mark = same.withColumn("_key", key)
    marked = mark.join(repeated, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_same")), "left").select(
        "conv_id", "turn", "role", "text", "n", F.coalesce(F.col("_first") < since, F.lit(False)).alias("seen")
    )
    order = ["conv_id", "turn", "role"]
    dealt = marked.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return materialize(dealt.mapInArrow(_blocked, _ORDERED), "repair-ordered")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits (conv_id, block, place, edit, role, text)``, one row per edit, ordered by block and place, with role
    and text as repaired (null where deleted); and ``summary (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit)``, one row per conversation of ``rows (conv_id, turn, role, text)``."""
    ordered = _ordered(rows)
    blocks = materialize(ordered.groupBy("bin").applyInArrow(_transfers, _BLOCKS), "repair-blocks")
    chained = materialize(
        blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chained, _CHAINED), "repair-chained"
    )
    parts = chained.filter("block IS NOT NULL").select("bin", "block", "q", "audit")
    edits = ordered.groupBy("bin").cogroup(parts.groupBy("bin")).applyInArrow(_edited, _EDITS)
    summary = chained.filter("block IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return edits, summary


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The summary of every conversation of ``original``, with the digest of its repaired ``role:text`` lines."""
    edits, summary = repair(rows)
    kept = edits.filter("edit <> 'D'")
    digests = kept.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    known = summary.withColumnRenamed("conv_id", "_s")
    hashes = digests.withColumnRenamed("conv_id", "_h")
    joined = every.join(known, F.col("conv_id").eqNullSafe(F.col("_s")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
