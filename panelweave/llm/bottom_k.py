"""Near duplicates by bottom-k sketches of one hash function.

A set's sketch is the ``SKETCH`` smallest hashes of its shingles. Inverted lists of retained values
bring together the sets that share some; how many lists two sets share is their overlap. Values that
many sets retain are passed over for the next ones; only a set that retains hardly anything else is
listed under them too. The sketch of a union follows from the two sketches, and the share of it that
both retain estimates the similarity; pairs that fall clearly short are ruled out, all others are
compared over their whole sets.

Two similar sets miss each other only if none of the first ``LISTED`` values of their union is common
to both, or if the estimate falls short by chance: both together have a probability below 1e-8 a pair
at the threshold, less above it, and none for sets that their sketches hold whole and uncommon.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import linking
from panelweave.llm.shared import free_name, small_batches
from panelweave.llm.shingles import shingle_set
from panelweave.session import materialize

WORDS, PERCENT = 3, 85
#: Values in a sketch, and those a set is listed under.
SKETCH, LISTED = 64, 12
#: Sets that retain a value for it to be common, and common values that are remembered: the most frequent.
COMMON_SETS, COMMON_MAX = 64, 200_000
#: Chance that the estimate rules out a pair at the threshold.
MISS = 1e-9
#: Classes whose sketch a task sends once only.
SEEN = 500_000


def set_of(text: str | None) -> np.ndarray:
    return shingle_set(text, WORDS)


MEASURE = linking.Measure(set_of, linking.AtLeast(PERCENT))


@cache
def least_shared(size: int, percent: int = PERCENT) -> int:
    """Shared values of a union sketch of ``size`` that a pair at the threshold has but for the chance ``MISS``."""
    p, below = percent / 100, 0.0
    for shared in range(size + 1):
        below += comb(size, shared) * p**shared * (1 - p) ** (size - shared)
        if below > MISS:
            return shared
    return size


def may_be_similar(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int = PERCENT) -> bool:
    """By the sketches ``a`` and ``b`` (sorted, unsigned) of sets with ``na`` and ``nb`` elements."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    ends = [s[-1] for s, n in ((a, na), (b, nb)) if n > len(s)]
    if ends:  # beyond the smaller end of a cut sketch the union is not known
        a, b = a[a <= min(ends)], b[b <= min(ends)]
    union = np.union1d(a, b)
    shared = len(a) + len(b) - len(union)
    return shared >= least_shared(len(union), percent)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, body, n, key and sketch of every row; copies in one task share the first's sketch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, key, sketch = [], [], []
            for text in batch["text"].to_pylist():
                s = set_of(text)
                k = linking.class_key(s) if len(s) else 0
                n.append(len(s))
                key.append(k)
                sketch.append(None if k in seen or not len(s) else s[:SKETCH].view(np.int64))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
            numbers = [pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["body"], *numbers], ["doc_id", "body", "n", "key", "sketch"])

    return docs.mapInArrow(made, "doc_id long, body long, n long, key long, sketch array<long>")


def _retained(sketches: list[np.ndarray], common: np.ndarray) -> list[np.ndarray]:
    """The values that each set is listed under; ``common`` is sorted, and searched once for all sets."""
    if not len(common):
        return [sketch[:LISTED] for sketch in sketches]
    whole = np.concatenate(sketches)
    uncommon = common[np.minimum(np.searchsorted(common, whole), len(common) - 1)] != whole
    out, at = [], 0
    for sketch in sketches:
        rare = sketch[uncommon[at : at + len(sketch)]]
        at += len(sketch)
        few = len(rare) < min(LISTED, len(sketch))
        out.append(np.unique(np.concatenate([rare, sketch[:LISTED]])) if few else rare[:LISTED])
    return out


def _listed(classes: DataFrame) -> DataFrame:
    """(value, key) of the inverted lists."""
    values = classes.select(F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_SETS)
    common = common.orderBy(F.desc("n"), "value").limit(COMMON_MAX).select("value").toPandas()["value"].to_numpy(dtype=np.int64)
    shared = classes.sparkSession.sparkContext.broadcast(np.sort(common))  # COMMON_MAX numbers at most

    @F.pandas_udf("array<long>")
    def chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_retained(batch.tolist(), shared.value), dtype=object)

    return classes.select("key", F.explode(chosen("sketch")).alias("value"))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that the estimate leaves."""

    @F.pandas_udf("boolean")
    def estimated(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        rows = zip(a, na, b, nb, strict=True)
        return pd.Series([may_be_similar(x.view(np.uint64), m, y.view(np.uint64), n) for x, m, y, n in rows], dtype=bool)

    x = classes.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x"))
    y = classes.select(F.col("key").alias("b"), "n", F.col("sketch").alias("y"))
    sizes = pairs.join(x.drop("x"), "a").join(y.drop("y"), "b").filter((100 * F.col("m") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("m")))
    held = sizes.select("a", "b").join(x, "a").join(y, "b")
    return held.filter(estimated("x", "m", "y", "n")).select("a", "b")


def _promising(crowd: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes of ``crowd`` (key, label, n) that may have a pair with another label that the estimate leaves.

    Such a pair shares ``least_shared`` of its union sketch, which is no smaller than either sketch; so
    a class is dropped that has fewer values which the sketch of a class with another label has.
    """
    held = crowd.select("key", "label").join(classes.select("key", "sketch"), "key")
    size = F.least("n", F.lit(SKETCH))
    alone = linking.elements_alone(held, "sketch", lambda sketch: np.array(sketch, dtype=np.int64).view(np.uint64), crowd.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    least = F.array(*[F.lit(least_shared(k)) for k in range(SKETCH + 1)])
    return crowd.join(alone, "key", "left").filter(size - F.coalesce("alone", F.lit(0)) >= F.get(least, size.cast("int"))).select(*crowd.columns)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Words are runs of other than ASCII white space with A-Z in lower case; a set holds the distinct runs
    of three words, of a shorter text all its words as one. Sets link at similarity 0.85 or more;
    component_id is the smallest doc_id that links reach and kept says that the row has it. A null or empty text has no shingles and
    is a component of its own, also where such rows repeat. Rows that repeat a doc_id are linked by their
    texts like others; null doc_ids are never a component_id where the component has another, and kept is
    null where there is none. Other columns are dropped; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = linking.keyed(docs, doc_id, text)
    rows = materialize(_sketched(docs), "sketched")
    full = rows.filter("n > 0")
    by_key = full.groupBy("key").agg(linking.first_row(), F.max("n").alias("n"))
    sketches = full.filter("sketch IS NOT NULL").groupBy("key").agg(F.first("sketch").alias("sketch"))
    classes = materialize(by_key.join(sketches, "key"), "classes")
    repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    listed = materialize(_listed(classes), "listed")
    lists = listed.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("key").alias("rank"), "key"))["key"].alias("head")).filter("size > 1")
    member = materialize(listed.join(lists, "value"), "members")
    agreeing = member.filter("key <> head").groupBy(F.col("head").alias("a"), F.col("key").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    is_short = F.col("size") <= linking.SMALL_LIST
    short = member.filter(is_short).groupBy("value").agg(F.array_sort(F.collect_list("key")).alias("members")).select("members").distinct()
    long = member.filter(~is_short).select(F.col("value").alias("bucket"), "key")
    label = linking.links(docs, classes, agreeing, short, long, lambda pairs: _likely(pairs, classes), MEASURE, repeated, lambda crowd: _promising(crowd, classes))
    out = linking.component_rows(rows, classes, label)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates_dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first document of each component; null ids and rows without words all stay."""
    found = near_duplicates(docs, doc_id, text).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("stays"))
    gone = free_name(docs, "gone")
    dropped = materialize(found.filter("NOT stays").select(F.col("doc_id").alias(gone)), "gone")
    return docs.join(dropped, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
