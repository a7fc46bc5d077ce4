"""Repair of damaged conversations by cheapest edits, found from both ends.

A conversation's rows and the role that was written last span a lattice: a column for each place
between rows, in it a state for each last role. Edits are its edges: Keep, Rerole, Delete go one column
on, Insert stays. A forward heap and a reverse heap are settled until no cheaper meeting is possible
and every crossing of the least cost is known; the least concatenated audit of these is the repair.

Rows are put in order by one range sort of the whole table and numbered by it, so a long conversation
spreads over many tasks. The lattice needs a small code for each row and no text. It is cut into
blocks of ``BLOCK_ROWS`` numbers; a conversation that lies in several blocks gets, for each pair of
states at a block's ends, the cheapest audit between them, and the same search over the blocks joins
those. Texts are streamed once in order where the repaired rows are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import numbered, small_batches
from panelweave.session import materialize

#: Rows of a block of the lattice.
BLOCK_ROWS = 1024
#: Copies of a group's first row, among which its other rows are dealt.
SALTS = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What was written last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
GOALS = (NOTHING, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after an inserted or renamed turn.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Role initials as codes; a row's code is this plus 4 times its fault.
INITIALS = "sua"
SOUND, CUT, GONE = range(3)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Edge = tuple[int, int, int, str]
Sides = tuple[tuple[tuple[Edge, ...], ...], tuple[tuple[Edge, ...], ...]]


def after_keep(state: int, initial: int) -> int | None:
    """The state after a kept row, None where it may not stand."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def sides(edges: Sequence[Edge]) -> Sides:
    """Edges (from, to, cost, audit) by the state they leave and by the state they reach."""
    return tuple(tuple(e for e in edges if e[0] == s) for s in STATES), tuple(tuple(e for e in edges if e[1] == s) for s in STATES)


def row_edges(code: int) -> list[Edge]:
    """The edits of a row."""
    initial, fault = code % 4, code // 4
    more = TRUNCATED if fault == CUT else 0
    out = [(s, s, DELETE, "D") for s in STATES]
    if fault != GONE:
        out += [(s, t, KEEP + more, "K") for s in STATES if (t := after_keep(s, initial)) is not None]
        out += [(s, NEXT[s], REROLE + more, "R") for s in STATES]
    return out


ROW = tuple(sides(row_edges(code)) for code in range(12))
INSERTS = sides([(s, NEXT[s], INSERT, "I") for s in STATES])
NO_EDGES = sides([])


def cheapest(steps: Sequence[Sides], within: Sides, starts: Sequence[int], goals: Sequence[int]) -> tuple[int, str] | None:
    """Least cost and, of that cost, least audit from ``starts`` in the first column to ``goals`` in the last.

    ``steps`` leads from column to column, ``within`` stays in one. Edges that stay cost something, so
    of nodes at the same cost those nearer to a heap's own end are settled first and labels are final
    when settled. No audit of a node starts with another one of the same cost: the longer would have
    inserts more. Least beginnings and ends therefore make the least whole.
    """
    last = len(steps)
    label: tuple[dict, dict] = ({(0, s): (0, "") for s in starts}, {(last, s): (0, "") for s in goals})
    heaps = ([(0, 0, s) for s in starts], [(0, 0, s) for s in goals])
    settled: tuple[set, set] = (set(), set())
    best = None

    def edges(side: int, column: int, state: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        for e in within[side][state]:
            yield (column, e[1 - side]), e[2], e[3]
        if side == 0 and column < last:
            for e in steps[column][0][state]:
                yield (column + 1, e[1]), e[2], e[3]
        elif side == 1 and column:
            for e in steps[column - 1][1][state]:
                yield (column - 1, e[0]), e[2], e[3]

    while True:
        for side in (0, 1):
            while heaps[side] and _node(heaps[side][0], side, last) in settled[side]:
                heappop(heaps[side])
        if not heaps[0] or not heaps[1]:
            if best is None or (not heaps[0] and not heaps[1]):
                break
            side = 0 if heaps[0] else 1
            if heaps[side][0][0] > best:
                break
        elif best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        else:
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        node = _node(heappop(heaps[side]), side, last)
        settled[side].add(node)
        cost, audit = label[side][node]
        if node in label[1 - side]:
            met = cost + label[1 - side][node][0]
            best = met if best is None else min(best, met)
        for to, price, letters in edges(side, *node):
            new = (cost + price, audit + letters if side == 0 else letters + audit)
            if to not in settled[side] and (to not in label[side] or new < label[side][to]):
                label[side][to] = new
                heappush(heaps[side], (new[0], to[0] if side == 0 else last - to[0], to[1]))
            if to in label[1 - side]:
                met = cost + price + label[1 - side][to][0]
                best = met if best is None else min(best, met)
    if best is None:
        return None
    crossings = []
    settled[0].update((0, s) for s in starts)  # the ends' own labels are final from the beginning
    settled[1].update((last, s) for s in goals)
    for node in settled[0]:
        cost, audit = label[0][node]
        if node in settled[1] and cost + label[1][node][0] == best:
            crossings.append(audit + label[1][node][1])
        for to, price, letters in edges(0, *node):
            if to in settled[1] and cost + price + label[1][to][0] == best:
                crossings.append(audit + letters + label[1][to][1])
    return best, min(crossings)


def _node(entry: tuple[int, int, int], side: int, last: int) -> tuple[int, int]:
    return (entry[1] if side == 0 else last - entry[1], entry[2])


@lru_cache(maxsize=20_000)
def block_paths(codes: bytes, first: bool, end: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of the cheapest ways through a block; of a whole conversation the cheapest one."""
    steps = [ROW[c] for c in codes]
    if first and end:
        return [(NOTHING, NOTHING, *cheapest(steps, INSERTS, (NOTHING,), GOALS))]
    out = []
    for s in (NOTHING,) if first else STATES:
        for t in GOALS if end else STATES:
            found = cheapest(steps, INSERTS, (s,), (t,))
            if found:
                out.append((s, t, *found))
    return out


def illegal_pairs(codes: bytes) -> int:
    return sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text after damage that crc32 of ``conv_id:turn`` chooses, of every row of ``turns``.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes its
    role user. Nulls count as one space, in the key too; a null turn stays null. Other columns are dropped.
    """
    space = F.lit(" ")
    c, n, r, t = (F.col(f"`{x}`") for x in (conv_id, turn, role, text))
    key = F.concat(F.coalesce(c.cast("string"), space), F.lit(":"), F.coalesce(n.cast("string"), space))
    rows = turns.select(c.alias("conv_id"), n.alias("turn"), F.coalesce(r, space).alias("role"), F.coalesce(t, space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def in_order(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with ``at``, their place in the order of conversation, turn (nulls first), role and text; written once.

    Null roles and texts become one space.
    """
    space = F.lit(" ")
    c, n, r, t = (F.col(f"`{x}`") for x in (conv_id, turn, role, text))
    rows = turns.select(c.alias("conv_id"), n.alias("turn"), F.coalesce(r, space).alias("role"), F.coalesce(t, space).alias("text"))
    rows = materialize(rows.orderBy("conv_id", "turn", "role", F.xxhash64("text")), "ordered")
    return materialize(numbered(rows, "at"), "in_order")


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn and the code of every row, no text."""
    text = F.col("text")
    light = rows.select(
        "conv_id",
        "at",
        "turn",
        "role",
        F.sha2(text.cast("binary"), 256).alias("digest"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        text.rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("stopped"),
        F.pmod("at", F.lit(SALTS)).alias("salt"),
    )
    groups = light.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))
    found = light.join(groups, same & ~F.col("blank"), "left")
    duplicate = F.coalesce(F.col("at") > F.col("earliest"), F.lit(False)) & ~F.col("blank")
    cut = ~F.col("blank") & ~duplicate & ~F.col("stopped")
    initial = F.when(F.col("role") == "", 3).otherwise(F.expr(f"coalesce(nullif(locate(substring(role, 1, 1), '{INITIALS}'), 0) - 1, 3)"))
    fault = F.when(F.col("blank") | duplicate, GONE).when(cut, CUT).otherwise(SOUND)
    return found.select("conv_id", "at", "turn", (initial + 4 * fault).cast("int").alias("code"), "blank", duplicate.alias("duplicate"), cut.alias("truncated"))


PATHS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _search(codes: pd.Series, first: pd.Series, end: pd.Series) -> pd.DataFrame:
    rows = [bytes(bytearray(c.tolist())) for c in codes]
    paths = [[{"entry": s, "exit": t, "cost": n, "audit": a} for s, t, n, a in block_paths(c, bool(f), bool(e))] for c, f, e in zip(rows, first, end, strict=True)]
    return pd.DataFrame({"illegal": [illegal_pairs(c) for c in rows], "paths": paths})


def _joined(conv: DataFrame) -> DataFrame:
    """The blocks of each conversation joined by the same search; 16 audit letters a row meet in a task."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        steps = [sides([(p["entry"], p["exit"], int(p["cost"]), p["audit"]) for p in paths]) for paths in rows["paths"]]
        cost, audit = cheapest(steps, NO_EDGES, (NOTHING,), GOALS)
        ends = list(zip(rows["head"], rows["tail"], strict=True))
        across = sum((a[1] % 4, b[0] % 4) not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "illegal": [int(rows["illegal"].sum()) + across], "cost": [cost], "audit": [audit]})

    id_type = conv.schema["conv_id"].dataType.simpleString()
    return conv.groupBy("conv_id").applyInPandas(join, f"conv_id {id_type}, illegal long, cost long, audit string")


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by conv_id, where null equals null."""
    right = right.withColumnRenamed("conv_id", "c")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("c")), how).drop("c")


def audits(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows`` (of ``in_order``) its faults and cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. A row's first fault counts: blank,
    said before by the same role, without a stop at its end. Gaps are missing turn numbers between
    the least and the greatest. Initials other than s, u and a are never legal and never kept.
    """
    coded = materialize(_coded(rows), "coded")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    block = F.floor(F.col("at") / BLOCK_ROWS).cast("long")
    blocks = coded.groupBy("conv_id", block.alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"), count("blank"), count("duplicate"), count("truncated")
    )
    blocks = materialize(blocks, "blocks")
    whole = blocks.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    placed = _same(blocks.select("conv_id", "block", "codes"), whole.select("conv_id", "low", "high"), "inner")
    first, end = F.col("block") == F.col("low"), F.col("block") == F.col("high")
    search = F.pandas_udf(_search, f"illegal long, paths {PATHS}")
    searched = placed.select("conv_id", "block", (first & end).alias("alone"), F.col("codes")[0].alias("head"), F.element_at("codes", -1).alias("tail"), search("codes", first, end).alias("found"))
    searched = materialize(searched.select("conv_id", "block", "alone", "head", "tail", "found.illegal", "found.paths"), "searched")
    short = searched.filter("alone").select("conv_id", "illegal", F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"))
    found = short.unionByName(_joined(searched.filter("NOT alone")))
    turns = coded.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = _same(_same(whole, found, "inner"), gaps, "inner")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text and edit (K, R or I), clustered and in order.

    ``rows`` and ``found`` are of ``in_order`` and ``audits``. A conversation's audit leads its rows into
    one task, which streams them and holds the audit and one batch.
    """
    spark = rows.sparkSession
    small_batches(spark)
    schema = rows.select("conv_id").schema
    lead = found.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = rows.select("conv_id", "at", "role", "text").unionByName(lead).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    id_type = schema["conv_id"].dataType.simpleString()

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, step, state, place, conv = "", 0, NOTHING, 0, None
        for batch in batches:
            out: list[tuple] = []
            for c, at, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "at", "role", "text")), strict=True):
                if at < 0:
                    conv, audit, step, state, place = c, text, 0, NOTHING, 0
                else:
                    letter, step = audit[step], step + 1
                    if letter == "K":
                        state = after_keep(state, INITIALS.index(role[0]))
                        out.append((conv, place, role, text, "K"))
                        place += 1
                    elif letter == "R":
                        state = NEXT[state]
                        out.append((conv, place, ROLES[state], text, "R"))
                        place += 1
                while step < len(audit) and audit[step] == "I":
                    state, step = NEXT[state], step + 1
                    out.append((conv, place, ROLES[state], "", "I"))
                    place += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "role", "text", "edit"])

    return stream.mapInArrow(applied, f"conv_id {id_type}, place long, role string, text string, edit string")


def hashes(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of ``turns``, as ``repaired`` returned them: role:text, joined by newlines."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, type_ = None, None, None
        for batch in batches:
            out, type_ = [], batch.schema.field("conv_id").type
            for c, place, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if h:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _hash_rows(out, type_)
        if h:
            yield _hash_rows([(conv, h.hexdigest())], type_)

    return turns.mapInArrow(hashed, f"conv_id {id_type}, repaired_sha256 string")


def _hash_rows(rows: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type_), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, repair and hash of the repaired turns for every conv_id of ``ids``.

    ``turns`` has conv_id, turn, role and text. Conversations without rows get zeros, an empty audit
    and the hash of nothing. Null ids are one conversation; rows that agree in turn are taken by role and text;
    an empty table gives an empty result; other columns are dropped.
    """
    rows = in_order(turns)
    found = materialize(audits(rows), "audits")
    digests = materialize(hashes(repaired(rows, found)), "hashes")
    out = _same(_same(ids.select("conv_id").distinct(), found, "left"), digests, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )

