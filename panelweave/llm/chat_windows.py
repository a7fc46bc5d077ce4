"""Conversations as training windows within a token budget.

The running sum of turn tokens decides which window a turn belongs to, so windows are chosen without
walking a conversation: a window takes the turns that begin in one stride of tokens, and a long turn
that would reach beyond the stride gets a window of its own. The opening system turn stands in front
of every window, the tail of the window before is repeated as history, and each assistant text is a
target exactly once: in history it is masked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.llm.shared import small_batches
from panelweave.llm.token_counts import count_ids
from panelweave.session import materialize

#: Strings with a meaning in this template or in other common ones. In a text they are broken by a
#: backslash after their first character; a backslash of the text itself is doubled.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = "<|end|>\n"
BUDGET = 1024
HISTORY = 128
#: Turns whose tokens are summed together, by turn number, before a conversation's sums are formed.
BLOCK_TURNS = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))


def piece(role: Column, text: Column) -> Column:
    return F.concat(head(role), escape(text), F.lit(END))


def _is(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def chat_windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, assistant: str = "assistant", system: str = "system") -> DataFrame:
    """Windows of the conversations in ``turns`` (conv_id, turn, role, text).

    Returns conv_id, window (tokens before it in its conversation), formatted, n_tokens, n_repeated
    (leading turns that an earlier window holds), loss (spans of formatted in code points, one for each
    new assistant text, empty ones too) and over_budget. Turns are ordered by number, then role, tokens
    and text, so repeated numbers have a fixed order and repeated rows stay. Null roles and texts count
    as empty, null turn numbers come first, null conv_ids form one conversation. A turn longer than the
    budget allows stays whole in a window marked over_budget, as do windows behind an over-long system
    turn. Other columns are dropped; an empty table gives an empty result.
    """
    small_batches(turns.sparkSession, 4096)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(count_ids(path, batch.tolist()), dtype="int64")

    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("n", tokens(piece(F.col("role"), F.col("text")))).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS))
    rows = materialize(rows, "turns")  # tokens are counted once
    order = ["turn", "role", "n", "text"]

    # Running sums in two steps: over blocks of turns, then inside a block.
    through = W.partitionBy("conv_id").orderBy("block")
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.sum("n").alias("total"), F.min(F.struct("turn", "role", "n")).alias("first"))
        .select(
            F.col("conv_id").alias("c"),
            F.col("block").alias("b"),
            F.coalesce(F.sum("total").over(through.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.first("first").over(through.rowsBetween(W.unboundedPreceding, 0)).alias("opening"),
        )
        .select("c", "b", "before", F.when(F.col("opening.role") == system, F.col("opening.n")).otherwise(0).alias("sys"))
    )
    inside = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(inside))
    rows = rows.join(blocks, _is(F.col("conv_id"), F.col("c")) & (F.col("block") == F.col("b")))
    at = F.col("before") + F.col("upto") - F.col("n")
    rows = rows.select(
        "conv_id",
        *order,
        "sys",
        ((at == 0) & (F.col("sys") > 0)).alias("opens"),
        F.greatest(F.lit(budget) - F.col("sys") - history, F.lit(budget // 4)).alias("room"),
        F.greatest(at - F.col("sys"), F.lit(0)).alias("s"),
    )
    rows = rows.withColumn("size", F.when(F.col("opens"), 0).otherwise(F.col("n"))).withColumn("stride", F.col("room") - F.floor(F.col("room") / 4))
    slot = F.floor(F.col("s") / F.col("stride"))
    beyond = (F.col("s") + F.col("size") > (slot + 1) * F.col("stride")) & (F.col("size") > F.col("room") - F.col("stride"))
    rows = rows.withColumns({"slot": slot, "alone": beyond})

    # A window is known by where it begins, so the next one is where this one ends.
    same = W.partitionBy("conv_id", "slot", "alone")
    rows = rows.withColumns({"window": F.min("s").over(same), "next": F.max(F.col("s") + F.col("size")).over(same)})
    left = F.col("next") - F.col("s")  # tokens from this turn to the end of its window
    turn = F.struct("s", (~F.col("opens")).alias("later"), "turn", "role", "n", "text", "repeated")
    own = rows.select("conv_id", "window", F.lit(False).alias("repeated"), "s", "opens", *order)
    again = rows.filter(~F.col("opens") & (left <= history)).select("conv_id", F.col("next").alias("window"), F.lit(True).alias("repeated"), "s", "opens", *order)
    windows = own.unionByName(again).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns")).filter(F.exists("turns", lambda t: ~t["repeated"]))

    opening = rows.filter("opens").select(
        F.col("conv_id").alias("c"),
        F.struct("s", F.lit(False).alias("later"), "turn", "role", "n", "text", F.lit(True).alias("repeated")).alias("opening"),
    )
    windows = windows.join(opening, _is(F.col("conv_id"), F.col("c")) & (F.col("window") > 0), "left")
    windows = windows.withColumn("turns", F.when(F.col("opening").isNotNull(), F.concat(F.array("opening"), "turns")).otherwise(F.col("turns")))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(head(t["role"]))
        size = F.char_length(escape(t["text"]))
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        new = (t["role"] == assistant) & ~t["repeated"]
        return F.struct(
            (start + size + len(END)).alias("at"),
            F.when(new, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    nothing = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans"))
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["n"])
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: piece(t["role"], t["text"])), "").alias("formatted"),
        n_tokens.alias("n_tokens"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("turns", nothing, add, lambda acc: acc["spans"]).alias("loss"),
        (n_tokens > budget).alias("over_budget"),
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[2:].partition("|>\n")
        out.append((unescape(role), unescape(text)))
    return out


class _Readback:
    """Digests of one conversation, window by window."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.windows = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, repeated: int, loss) -> None:
        for role, text in read_turns(formatted)[repeated:]:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)
        self.windows += 1

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows)


READBACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation's turns and targets, taken from the formatted windows alone.

    A conversation passes through its task window by window; nothing but the digests is held.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in READBACK.split(", ")]
        now = None
        for batch in batches:
            done = []
            for conv_id, formatted, repeated, loss in zip(batch.conv_id.astype("Int64"), batch.formatted, batch.n_repeated, batch.loss, strict=True):
                conv_id = None if conv_id is pd.NA else conv_id
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Readback(conv_id)
                now.add(formatted, repeated, loss)
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names).astype({"conv_id": "Int64"})

    small_batches(windows.sparkSession, 4096)
    sorted_ = windows.select("conv_id", "window", "formatted", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return sorted_.mapInPandas(digests, READBACK)
