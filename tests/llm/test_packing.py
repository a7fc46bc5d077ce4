import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.llm.packing import _packer, pack, sum_of_squares, token_pieces
from panelweave.llm.shared import numbered
from panelweave.llm.tokens import load

PATH = public_tokenizers.path("word_bpe_49k.json")


def gapless(rows, capacity):
    """rows of (sequence, offset, length)"""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def plain_sum_of_squares(lengths, capacity):
    bins = []
    for size in sorted(lengths, reverse=True):
        def squares(gaps):
            return sum(v * v for v in np.bincount([g for g in gaps if g], minlength=1))

        choices = [(squares([*bins[:i], g - size, *bins[i + 1 :]]), g, i) for i, g in enumerate(bins) if g >= size]
        choices.append((squares([*bins, capacity - size]), capacity, len(bins)))
        _, g, i = min(choices)
        bins[i : i + 1] = [g - size]
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_each_choice_is_the_smallest_sum(lengths):
    s, o = sum_of_squares(np.array(lengths, dtype=np.int64), 12)
    gapless(zip(s, o, lengths), 12)
    fill = np.bincount(s, weights=lengths) if lengths else []
    assert sorted(12 - int(f) for f in fill) == plain_sum_of_squares(lengths, 12)


def test_documents(spark):
    tokenizer = load(PATH)
    texts = [None, "", "a b c", "word " * 9000, "x" * 30_000] + [f"doc {i} " * (i % 90) for i in range(400)] + ["same text"] * 50
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)] + [(7, "twice", "e", 1)] * 2, "doc_id long, text string, ids string, length int")
    pieces = token_pieces(df, PATH).withColumn("crc", F.crc32("ids")).drop("ids")
    rows = pack(pieces, block_pieces=100).collect()
    n = gapless([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    total = sum(r.length for r in rows)
    assert n <= math.ceil(total / 4096) * 1.25 + 1
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted((r.piece, r.start, r.length, r.crc) for r in rows if r.doc_id == i and not (i == 7 and r.length == 2))
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert got == want or i == 7
    assert sum(r.doc_id == 7 for r in rows) == 3


def test_empty_and_wrong(spark):
    assert pack(token_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []
    with pytest.raises(Exception, match="length"):
        pack(spark.createDataFrame([(5000,)], "length long"))


def test_clashing_columns(spark):
    rows = [(i, 100 + i % 7, f"b{i}", True, "f", "r") for i in range(30)] + [(3, 103, "b3", True, "f", "r")]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, block string, good boolean, file string, row_no string")
    got = pack(pieces, capacity=1000).collect()
    assert sorted((r["doc_id"], r["length"], r["block"], r["row_no"]) for r in got) == sorted((r[0], r[1], r[2], r[5]) for r in rows)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1000


def test_rows_are_not_shuffled_to_be_numbered(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "rows"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")  # less than the rows take
    try:
        rows = numbered(spark.read.parquet(str(tmp_path / "rows")))
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.row_no for r in rows.collect()) == [*range(1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_places_do_not_depend_on_the_order_in_which_rows_arrive():
    rows = pd.DataFrame({"row": range(60), "length": [300 + i % 3 for i in range(60)], "block": 0})
    mixed = rows.sample(frac=1, random_state=1)
    got, want = (_packer(0, 1000, 0.9)((0,), x).sort_values("row", ignore_index=True) for x in (mixed, rows))
    pd.testing.assert_frame_equal(got, want)
