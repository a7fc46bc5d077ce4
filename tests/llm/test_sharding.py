import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import sharding
from panelweave.llm.sharding import Node, place, shard_documents, uniform_tree


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    keys = spark.range(40_000)
    weights = {3: 2.0, 17: 0.0}
    trees = {"a": uniform_tree(40), "b": uniform_tree(41), "w": uniform_tree(40, weights)}
    rows = keys.select("id", *[place(F.col("id"), t).alias(k) for k, t in trees.items()]).collect()
    n = Counter(r.a for r in rows)
    assert set(n) == set(range(40)) and all(800 < v < 1200 for v in n.values())
    assert all(r.b in (r.a, 40) for r in rows) and 800 < sum(r.b == 40 for r in rows) < 1200
    w = Counter(r.w for r in rows)
    assert w[17] == 0 and 1800 < w[3] < 2200
    assert all(r.a == r.w or r.w == 3 or r.a == 17 for r in rows)


def plain_place(key, node):
    """Descent level by level: (draw, shard) of the child whose shards draw least."""
    if node.shard is not None:
        h = xxhash.xxh64(key.to_bytes(8, "little"), seed=xxhash.xxh64(node.name.encode(), seed=42).intdigest()).intdigest()
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / node.own_weight, node.shard
    return min(plain_place(key, c) for c in node.children if c.weight > 0)


def test_plain_descent(spark):
    tree = uniform_tree(23, {4: 3.0, 11: 0.25, 19: 0.0})
    for r in spark.range(3_000).select("id", place(F.col("id"), tree).alias("s")).collect():
        assert r.s == plain_place(r.id, tree)[1]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    trees = [uniform_tree(n) for n in range(1, 62)]
    before = [plain_place(k, trees[0])[1] for k in range(400)]
    for n, tree in enumerate(trees[1:], start=1):
        after = [plain_place(k, tree)[1] for k in range(400)]
        assert all(x in (y, n) for x, y in zip(after, before, strict=True))
        before = after
    steps = (5, 12, 38, 41, 46)
    wanted = sorted({n for s in steps for n in (s, s + 1)})
    rows = spark.range(20_000).select(*[place(F.col("id"), uniform_tree(n)).alias(f"n{n}") for n in wanted]).collect()
    for s in steps:
        moved = [r for r in rows if r[f"n{s}"] != r[f"n{s + 1}"]]
        assert all(r[f"n{s + 1}"] == s for r in moved)
        assert 0.7 < len(moved) * (s + 1) / len(rows) < 1.3


def test_no_weight(spark):
    with pytest.raises(ValueError):
        place(F.lit(1), uniform_tree(1, {0: 0.0}))


def test_single_shard(spark):
    assert spark.range(3).select(place(F.col("id"), uniform_tree(1)).alias("s")).distinct().collect()[0].s == 0


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    rows = [(i, f"text {i}" if i % 5 else None, 1) for i in range(600)] + [(3, "x" * 100_000, 1)] * 300 + [(None, "", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_documents(df, uniform_tree(6), uniform_tree(7)).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert shard_documents(df.limit(0), uniform_tree(6)).collect() == []


def test_node_weight():
    assert Node("r", (Node("a", shard=0, own_weight=2.0), Node("b", shard=1))).weight == 3.0
