"""Repair of the turn structure of conversations at least cost, by a rank-compressed dynamic program.

Rows of a conversation are layers; states are what was said last (nothing, system, user, assistant). Between two layers a
path takes one macro edit: a run of up to two inserts and then what is done with the row (``D``, ``K`` or ``R``). No macro is a
prefix of another, so audit strings compare as their sequences of macros do, and the nine macros are numbered in
ASCII order. A state keeps no audit string, only the *rank* of its least cheapest one among the states of its layer: (rank of
the parent, macro) orders the next layer's candidates as the whole strings would, and is ranked anew. Parent
pointers give the string back from the end.

Rows are sorted by conversation and turn over ranges, so a conversation of any size spreads over tasks; they are taken in
segments of 4,096 rows or 4 MB. A conversation that lies in one segment is settled there. Of any other, each segment gives its cheapest cost and the
rank of its audit from each state to each state: a macro edit again, of a whole segment. The same program over
segments picks the states between them, and each segment is then reconstructed for its own two. Only the
digest of a conversation reads its repaired text in one stream, piece by piece, as SHA-256 must.

Rows that repeat an earlier row's role and text are found by aggregation (the least of each group), and marked by a row that sorts just
before them; no text is joined, and no group of copies meets in one task.

Defined results: null role or text is one space, and so is a null conv_id or turn in the key of ``damage``; null turns come
first; rows of one turn are ordered by role and then by the SHA-256 of the text; rows that repeat are rows of their own. A null conv_id is a conversation. The
initial of a role is its first character, so other roles than the three are rewritten or deleted. A conversation without rows after damage has zeros, an
empty audit and the digest of the empty text. Empty tables give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch

ROWS = 4096
BYTES = 4 << 20
MACROS = sorted(run + edit for run in ("", "I", "II") for edit in "DKR")
TAILS = ("", "I", "II")
KEEP, REWRITE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: From each state (0 nothing, 1 system, 2 user, 3 assistant): the role that comes next, and its state.
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_NAMES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3
_edges: dict[tuple[str, int], list[list[tuple[int, int, int]]]] = {}

_FIGURES = ["rows", "blank", "duplicate", "truncated", "illegal", "least_turn", "most_turn", "turns"]
_DONE = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that crc32 of ``conv_id:turn`` modulo 20 tells."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def edges(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each state, the (state after, macro, cost) of the macro edits of a row."""
    key = (initial if initial in ("s", "u", "a") else "", fault)
    if key not in _edges:
        out = []
        extra = TRUNCATED if fault == CUT else 0
        for start in range(4):
            state, made = start, []
            for run in range(3):
                cost, number = run * INSERT, lambda edit, run=run: MACROS.index("I" * run + edit)
                made.append((state, number("D"), cost + DELETE))
                if fault not in (BLANK, DUPLICATE):
                    role, then = _NEXT[state]
                    if key[0] == role:
                        made.append((then, number("K"), cost + KEEP + extra))
                    else:
                        made.append((then, number("R"), cost + REWRITE + extra))
                        if key[0] == "s" and state == 0:
                            made.append((1, number("K"), cost + KEEP + extra))
                state = _NEXT[state][1]
            out.append(made)
        _edges[key] = out
    return _edges[key]


class Program:
    """Layers over one conversation or segment. ``now`` holds, for each (first state, state), the least
    cost and the rank of the least audit at that cost; ``back`` the parents by layer."""

    def __init__(self, starts: tuple[int, ...] = (0,)):
        self.now = {(s, s): (0, 0) for s in starts}
        self.back: list[dict[tuple[int, int], tuple[int, int]]] = []

    def step(self, ways: list[list[tuple[int, int, int]]]) -> None:
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for (start, state), (cost, rank) in self.now.items():
            for then, code, more in ways[state]:
                found = (cost + more, rank, code, state)
                if found < best.get((start, then), (1 << 62, 0, 0, 0)):
                    best[start, then] = found
        ranks = {x: i for i, x in enumerate(sorted({x[1:3] for x in best.values()}))}
        self.now = {k: (x[0], ranks[x[1:3]]) for k, x in best.items()}
        self.back.append({k: (x[3], x[2]) for k, x in best.items()})

    def end(self) -> tuple[int, int, int]:
        """Cost, last state and number of inserts after the last row, of the cheapest legal path from nothing."""
        tails = {0: 0, 3: 0, 2: 1, 1: 2}
        found = [(cost + n * INSERT, rank, n, state) for (start, state), (cost, rank) in self.now.items() if start == 0 for n in {tails[state], *([2] if state == 0 else [])}]
        cost, _, n, state = min(found)
        return cost, state, n

    def path(self, start: int, state: int) -> list[tuple[int, int]]:
        """(state before, code) layer by layer."""
        out = []
        for layer in reversed(self.back):
            state, code = layer[start, state]
            out.append((state, code))
        return out[::-1]


def written(path: list[tuple[int, int]], roles: list[str], texts: list[str]) -> tuple[str, list[str]]:
    """Audit and repaired lines of a segment's path."""
    audit, lines = [], []
    for (state, code), role, text in zip(path, roles, texts, strict=True):
        macro = MACROS[code]
        audit.append(macro)
        for _ in macro[:-1]:
            name, state = _NEXT[state]
            lines.append(_NAMES[name] + ":")
        if macro[-1] == "K":
            lines.append(f"{role}:{text}")
        elif macro[-1] == "R":
            lines.append(f"{_NAMES[_NEXT[state][0]]}:{text}")
    return "".join(audit), lines


def tail(state: int, n: int) -> list[str]:
    lines = []
    for _ in range(n):
        name, state = _NEXT[state]
        lines.append(_NAMES[name] + ":")
    return lines


class Segment:
    """Rows of one conversation that stand together, and the figures of their structure."""

    def __init__(self) -> None:
        self.roles, self.texts, self.faults, self.turns, self.bytes = [], [], [], [], 0

    def add(self, role: str, text: str, fault: int, turn: int | None) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.turns.append(turn)
        self.bytes += len(text)

    def program(self, starts: tuple[int, ...]) -> Program:
        out = Program(starts)
        for role, fault in zip(self.roles, self.faults, strict=True):
            out.step(edges(role[:1], fault))
        return out

    def figures(self) -> dict:
        known = [t for t in self.turns if t is not None]
        pairs = [a[:1] + b[:1] for a, b in zip(self.roles, self.roles[1:], strict=False)]
        return {
            "rows": len(self.roles), **{k: self.faults.count(i) for k, i in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "least_turn": known[0] if known else None,
            "most_turn": known[-1] if known else None, "turns": len(set(known)), "first": self.roles[0][:1] if self.roles else "", "last": self.roles[-1][:1] if self.roles else "",
        }


def joined(a: dict | None, b: dict) -> dict:
    """Figures of two segments, one after the other."""
    if not a or not a["rows"]:
        return b
    if not b["rows"]:
        return a
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out["turns"] -= a["most_turn"] is not None and a["most_turn"] == b["least_turn"]
    out["least_turn"] = b["least_turn"] if a["least_turn"] is None else a["least_turn"]
    out["most_turn"] = a["most_turn"] if b["most_turn"] is None else b["most_turn"]
    return out | {"first": a["first"], "last": b["last"]}


def result(conv_id: object, figures: dict, cost: int, audit: str, digest: str) -> dict:
    gaps = 0 if figures["least_turn"] is None else figures["most_turn"] - figures["least_turn"] + 1 - figures["turns"]
    return {"conv_id": conv_id, "gaps": gaps, **{k: figures[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1000, bytes_: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.pop("_bytes", 100)
        if len(held) >= most or size >= bytes_:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _task(work: Callable[[Iterator[dict]], Iterator[dict]], df: DataFrame, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 500) for row in batch.slice(at, 500).to_pylist())
        return _batches(work(rows), kind)

    return df.mapInArrow(run, schema)


def _settle(rows: Iterator[dict], most_rows: int, most_bytes: int) -> Iterator[dict]:
    """Conversations that lie in one segment, done; segments of the others. Rows come sorted."""
    part, count = TaskContext.get().partitionId(), 0
    segment, whole, conv, first = Segment(), False, None, False

    def open_one() -> dict:
        nonlocal count
        table = segment.program((0, 1, 2, 3)).now
        flat = [x for s in range(4) for t in range(4) for x in table.get((s, t), (-1, -1))]
        count += 1
        return {
            "conv_id": conv, "seg": (part << 32) + count, "table": flat, "roles": segment.roles, "texts": segment.texts, "faults": segment.faults, **segment.figures(),
            "_bytes": segment.bytes + 100 * len(segment.roles),
        }

    def closed() -> dict:
        program = segment.program((0,))
        cost, state, n = program.end()
        audit, lines = written(program.path(0, state), segment.roles, segment.texts)
        lines += tail(state, n)
        digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
        return result(conv, segment.figures(), cost, audit + "I" * n, digest)

    begun = False
    for row in rows:
        if row["kind"] == 0 or not begun:
            if begun:
                yield closed() if whole else open_one()
            segment, whole, conv, begun = Segment(), row["kind"] == 0, row["conv_id"], True
        if row["kind"] == 0:
            continue
        if row["mark"] == 0:
            first = True
            continue
        if len(segment.roles) >= most_rows or segment.bytes >= most_bytes:
            whole = False
            yield open_one()
            segment = Segment()
        fault = row["fault"] if row["fault"] == BLANK or first else DUPLICATE
        segment.add(row["role"], row["text"], fault, row["turn"])
        first = False
    if begun:
        yield open_one()  # the next range may go on with it


def _by_conversation(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """The rows of one conversation after another; they come sorted."""
    conv, held = None, None
    for row in rows:
        if held is None or row["conv_id"] != conv:
            if held is not None:
                yield held
            conv, held = row["conv_id"], []
        held.append(row)
    if held is not None:
        yield held


def _choose(rows: Iterator[dict]) -> Iterator[dict]:
    """The states between the segments of each conversation."""
    for segments in _by_conversation(rows):
        program, figures = Program((0,)), None
        for x in segments:
            t = x["table"]
            program.step([[(then, t[8 * s + 2 * then + 1], t[8 * s + 2 * then]) for then in range(4) if t[8 * s + 2 * then] >= 0] for s in range(4)])
            figures = joined(figures, x)
        cost, state, n = program.end()
        starts = [s for s, _ in program.path(0, state)]
        for i, (x, s) in enumerate(zip(segments, starts, strict=True)):
            last = i + 1 == len(segments)
            yield {"seg": x["seg"], "start": s, "state": state if last else starts[i + 1], "tail": n if last else None, **({"cost": cost, **{k: figures[k] for k in _FIGURES}} if last else {})}


def _rebuild(rows: Iterator[dict]) -> Iterator[dict]:
    """Audit and repaired lines of each segment between its two states."""
    for x in rows:
        segment = Segment()
        segment.roles, segment.texts, segment.faults = x["roles"], x["texts"], x["faults"]
        path = segment.program((x["start"],)).path(x["start"], x["state"])
        audit, lines = written(path, segment.roles, segment.texts)
        if x["tail"]:
            lines += tail(x["state"], x["tail"])
        audit += "I" * (x["tail"] or 0)
        lines = "\n".join(lines) if lines else None
        yield {"conv_id": x["conv_id"], "seg": x["seg"], "piece": audit, "lines": lines, "cost": x["cost"], **{k: x[f"all_{k}"] for k in _FIGURES}, "_bytes": len(lines or "")}


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    """Pieces of each conversation as one stream; its last one carries the figures."""
    audit, digest, begun = [], hashlib.sha256(), False
    for x in rows:
        audit.append(x["piece"])
        if x["lines"] is not None:
            digest.update((("\n" if begun else "") + x["lines"]).encode("utf-8", "surrogatepass"))
            begun = True
        if x["cost"] is not None:
            yield result(x["conv_id"], x, x["cost"], "".join(audit), digest.hexdigest())
            audit, digest, begun = [], hashlib.sha256(), False


def repair(conversations: DataFrame, damaged: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """One row for each conv_id of ``conversations``: the structure of its rows in ``damaged``
    (``conv_id, turn, role, text``), the cost and audit of the cheapest repair, and the digest of what it makes.
    ``most_rows`` and ``most_bytes`` bound a segment, and change no result."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    rows = damaged.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("sha"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"))
    rows = _scratch.write_table(rows, "turns")
    firsts = rows.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn", "row")).alias("least"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = firsts.select("conv_id", F.lit(1).alias("kind"), "least.turn", "role", "sha", "least.row", F.lit(0).alias("mark"), none("string", "text"), none("int", "fault"))
    heads = conversations.groupBy("conv_id").agg(F.lit(0).alias("kind")).select(
        "conv_id", "kind", none("long", "turn"), none("string", "role"), none("string", "sha"), none("long", "row"), none("int", "mark"), none("string", "text"), none("int", "fault"),
    )
    full = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "sha", "row", F.lit(1).alias("mark"), "text", "fault")
    order = ["conv_id", "kind", "turn", "role", "sha", "row"]
    ranged = heads.union(marks).union(full).repartitionByRange(*order).sortWithinPartitions(*order, "mark").drop("sha", "row")
    figures = ", ".join(f"{k} long" for k in _FIGURES)
    done = _DONE.format(kind)
    settled = _task(partial(_settle, most_rows=most_rows, most_bytes=most_bytes), ranged, f"{done}, seg long, table array<long>, roles array<string>, texts array<string>, faults array<int>, rows long, least_turn long, most_turn long, turns long, first string, last string")
    settled = _scratch.write_table(settled, "settled")
    closed = settled.where("seg is null").select(*[c.split()[0] for c in done.split(", ")])
    parts = settled.where("seg is not null")
    slim = parts.select("conv_id", "seg", "table", "first", "last", *_FIGURES).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    chosen = _task(_choose, slim, f"seg long, start int, state int, tail int, cost long, {figures}")
    chosen = chosen.select("seg", "start", "state", "tail", F.col("cost").alias("all_cost"), *[F.col(k).alias(f"all_{k}") for k in _FIGURES])
    both = parts.select("conv_id", "seg", "roles", "texts", "faults").join(chosen, "seg").withColumnRenamed("all_cost", "cost")
    pieces = _task(_rebuild, both, f"conv_id {kind}, seg long, piece string, lines string, cost long, {figures}")
    return closed.union(_task(_digest, pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), done))
