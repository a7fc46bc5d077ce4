"""Benchmark items inside documents, by MinHash containment in partitions of size.

An item is short and a document may be long, so the two sets of shingles are never alike; what counts
is the share of the item's shingles that the document holds. Items are partitioned by size. All items
of a partition get a sketch of as many smallest hashes: what an item of its upper end may lack at the
wanted share, one more, and a few to spare. By the pigeonhole principle a document that holds enough of
the item holds at least so many of these hashes, however long it is; it looks only at partitions that
its own size can hold. Candidates are then counted over all shingles of the item, so results are exact.

Shingles are compared as 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import small_batches
from panelweave.llm.shingles import shingle_set
from panelweave.session import materialize

#: Share of an item's shingles, in percent, that a document must hold.
SHARE = 75
#: Hashes of a sketch beyond those that the pigeonhole principle asks for; each is one more hit to ask for.
SPARE = 4
#: Shingles of all items together that are broadcast (8 bytes each); beyond them the sets are joined by shuffles.
MAX_BROADCAST = 2_000_000
_U = np.uint64


def partition_of(n: int) -> tuple[int, int]:
    """Smallest and largest size of the partition of items with ``n`` shingles; each a third wider than the last."""
    low = 1
    while True:
        above = max(low + 1, -(-low * 4 // 3))
        if n < above:
            return low, above - 1
        low = above


def sketch_plan(n: int, share: int = SHARE) -> tuple[int, int, int]:
    """Of an item with ``n`` shingles: hashes in its sketch, hits among them, and shingles a document must have."""
    low, high = partition_of(n)
    kept = min(n, high - -(-share * high // 100) + 1 + SPARE)
    return kept, kept - (n - -(-share * n // 100)), -(-share * low // 100)


def _sets(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id and body (which tell rows apart), n and s: the sorted shingles; none without words, repeated rows once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"].to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            s = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["body"], n, s], ["id", "body", "n", "s"])

    return _keyed(docs, id_, text).mapInArrow(made, "id long, body long, n long, s array<long>").filter("n > 0").dropDuplicates(["id", "body"])


def _keyed(docs: DataFrame, id_: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("body"), F.col(f"`{text}`").alias("text"))


PAIRS = "id long, body long, item long, n long, held long"


class Index:
    """Sketches of a bounded number of items, by hash, and the items' whole sets."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], share: int) -> None:
        self.items = items
        self.enough = np.array([-(-share * len(s) // 100) for _, s in items], dtype=np.int64)
        plans = [sketch_plan(len(s), share) for _, s in items]
        self.hits = np.array([p[1] for p in plans], dtype=np.int64)
        self.least = np.array([p[2] for p in plans], dtype=np.int64)
        nothing = np.zeros(0, dtype=_U)
        hashes = np.concatenate([nothing, *(s[: p[0]] for (_, s), p in zip(items, plans, strict=True))])
        owners = np.repeat(np.arange(len(items)), [p[0] for p in plans])
        order = np.argsort(hashes, kind="stable")
        self.owners = owners[order]
        self.hashes, self.starts = np.unique(hashes[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)]

    def search(self, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """Items that the set ``s`` holds, with the number of their shingles in it."""
        few, many = (s, self.hashes) if len(s) < len(self.hashes) else (self.hashes, s)
        if not len(few):
            return
        met = few[many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few]
        if not len(met):
            return
        at = np.searchsorted(self.hashes, met)
        owners = np.concatenate([self.owners[a:b] for a, b in zip(self.starts[at], self.ends[at], strict=True)])
        for k, hits in zip(*np.unique(owners, return_counts=True), strict=True):
            if hits >= self.hits[k] and len(s) >= self.least[k]:
                item = self.items[k][1]
                held = int((s[np.minimum(np.searchsorted(s, item), len(s) - 1)] == item).sum())
                if held >= self.enough[k]:
                    yield k, held


def _search_broadcast(docs: DataFrame, items: DataFrame, share: int) -> DataFrame:
    rows = items.select("id", "s").collect()  # at most MAX_BROADCAST numbers
    index = Index([(r["id"], np.array(r["s"], dtype=np.int64).view(_U)) for r in rows], share)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            row, item, n, held = [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for k, count in index.search(shingle_set(text)):
                    row.append(i)
                    item.append(index.items[k][0])
                    n.append(len(index.items[k][1]))
                    held.append(count)
            at = pa.array(row, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (item, n, held)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["body"].take(at), *numbers], ["id", "body", "item", "n", "held"])

    return docs.mapInArrow(searched, PAIRS).distinct()


def _search_joined(docs: DataFrame, items: DataFrame, share: int) -> DataFrame:
    """The same by joins on the hash, for items of any number; no set is gathered or broadcast."""
    sets = materialize(_sets(docs, "id", "text"), "document_sets")
    plan = F.udf(lambda n: sketch_plan(n, share), "kept long, hits long, least long")  # once for each size
    plans = materialize(items.select("n").distinct().withColumn("p", plan("n")).select("n", "p.*"), "plans")
    named = materialize(items.withColumn("key", F.struct(F.col("id").alias("item"), F.col("body").alias("item_body"))).join(plans, "n"), "items")
    # Shingles are ordered as unsigned numbers.
    sketches = named.select("key", "hits", "least", F.explode(F.slice("s", F.lit(1), F.col("kept").cast("int"))).alias("h"))
    each = sets.select(F.struct("id", "body").alias("doc"), F.col("n").alias("size"), F.explode("s").alias("h"))
    met = each.join(sketches, "h").filter("size >= least").groupBy("doc", "key", "hits").agg(F.count(F.lit(1)).alias("met")).filter("met >= hits")
    candidates = materialize(met.select("doc", "key"), "candidates")
    wanted = candidates.join(named.select("key", "n", F.explode("s").alias("h")), "key")
    held = wanted.join(each.select("doc", "h"), ["doc", "h"], "left_semi").groupBy("doc", "key", "n").agg(F.count(F.lit(1)).alias("held"))
    return held.filter(100 * F.col("held") >= share * F.col("n")).select("doc.id", "doc.body", "key.item", "n", "held").distinct()


def _search(docs: DataFrame, benchmark: DataFrame, share: int, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    if not 1 <= share <= 100:
        raise ValueError("share is a percentage from 1 to 100")
    small_batches(docs.sparkSession)
    items = materialize(_sets(benchmark, item_id, item_text), "items")
    size = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    search = _search_broadcast if size <= MAX_BROADCAST else _search_joined
    return search(_keyed(docs, doc_id, text), items, share)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: int = SHARE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, item_shingles and held_shingles for every item that a document holds.

    A document holds an item if it has at least ``share`` percent of the item's distinct shingles: runs
    of five words between ASCII white space, A-Z in lower case. A text of fewer words is one shingle of
    all its words, so such an item is held only by a document of the same few words. Null and empty
    texts hold nothing and are held by nothing. Repeated rows give one row; rows that repeat an id with
    another text are searched each; null ids stay null. Other columns are ignored. An empty table on
    either side gives an empty result.
    """
    found = _search(docs, benchmark, share, doc_id, text, item_id, item_text)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("item_shingles"), F.col("held").alias("held_shingles"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, share: int = SHARE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns; see ``contaminated``. Null texts stay."""
    found = _search(docs, benchmark, share, doc_id, text, item_id, item_text)
    gone = materialize(found.select(F.col("id").alias("__id"), F.col("body").alias("__body")).distinct(), "contaminated")
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__body"))
    return docs.join(gone, same, "left_anti")
