"""Sequences of a fixed number of tokens, packed by the sum of squares.

Each piece goes where the sum, over all residual gaps, of the squared number of open sequences with
that gap becomes smallest. That keeps the gaps varied, so that a sequence that a later piece fills
exactly is likely to be open. Blocks of pieces are packed apart from each other; what stays badly
filled is opened and packed again, in fewer blocks each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import free_name, numbered, small_batches, text_of
from panelweave.llm.tokens import encoder
from panelweave.session import materialize

CAPACITY = 4096
END_OF_TEXT = 1
#: Pieces that one task packs together.
BLOCK_PIECES = 20_000
#: A sequence filled less than this is opened and packed again in the next round.
WELL_FILLED = 0.995
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACES = "row long, length long, sequence_id long, offset long, good boolean"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_OF_TEXT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian, 4 bytes each) of every document.

    A document's ids are those of its whole text and ``end`` behind them; a null text counts as empty
    and gives the end alone. Only documents of more than ``capacity`` ids are cut. Repeated rows are
    encoded each; other columns are dropped; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for i, ids in enumerate(enc.encode(batch["text"].to_pylist())):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, part))
            row, piece, start, length, ids = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest first; of equal effects the smallest gap is taken."""
    n = len(lengths)
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap; full ones are not counted
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        best, effect = capacity, 2 * count[capacity - size] + 1 if size < capacity else 0  # a new sequence
        gaps = size + np.flatnonzero(count[size:])
        if len(gaps):
            effects = 2 * (count[gaps - size] - count[gaps] + 1)
            if gaps[0] == size:
                effects[0] = 1 - 2 * count[size]
            k = int(np.argmin(effects))
            if effects[k] <= effect:
                best = int(gaps[k])
        if best < capacity:
            s = open_[best].pop()
            count[best] -= 1
        else:
            s, made = made, made + 1
        sequence[i], offset[i] = s, capacity - best
        if best > size:
            open_[best - size].append(s)
            count[best - size] += 1
    return sequence, offset


def _packer(base: int, capacity: int, well_filled: float):
    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ascending=False, ignore_index=True)  # of equal lengths the last row is placed first
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows = rows.drop(columns="block")
        rows["sequence_id"], rows["offset"] = base + (int(key[0]) << 32) + sequence, offset
        fill = np.bincount(sequence, weights=rows["length"].to_numpy())
        rows["good"] = fill[sequence] >= well_filled * capacity
        return rows

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, rounds: int = ROUNDS, well_filled: float = WELL_FILLED) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` (1 to ``capacity``) is a column of theirs.

    Offsets of a sequence run from 0 without a gap. All other columns stay. Repeated rows are packed
    each; an empty table gives an empty result. A length outside the range fails the job. Only numbers and
    lengths of rows are packed; the rows themselves are joined to their places at the end.
    """
    for name in ("sequence_id", "offset"):
        if name in pieces.columns:
            raise ValueError(f"pieces has a column {name} already")
    length, row = F.col("length"), free_name(pieces, "row_no")
    wrong = F.raise_error(F.concat(F.lit("a length is outside 1 to capacity: "), length.cast("string")))
    whole = numbered(materialize(pieces.withColumn("length", F.when(length.between(1, capacity), length).otherwise(wrong)), "pieces"), row)
    left = materialize(whole.select(F.col(row).alias("row"), F.col("length").cast("long").alias("length")), "lengths")
    out = None
    for number in range(rounds):
        n = left.count()
        blocks = max(1, -(-n // block_pieces))
        final = number == rounds - 1 or blocks == 1
        dealt = left.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        done = dealt.groupBy("block").applyInPandas(_packer(number << 56, capacity, well_filled), PLACES)
        done = materialize(done, f"packed{number}")
        good = (done if final else done.filter("good")).select(F.col("row").alias(row), "sequence_id", "offset")
        out = good if out is None else out.unionByName(good)
        if final:
            break
        left = materialize(done.filter("NOT good").select("row", "length"), f"left{number}")
    return whole.join(out, row).drop(row)
