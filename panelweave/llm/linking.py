"""From candidate lists of sets to links that connect all that similar pairs connect.

A class is the documents with one and the same set, named by a hash of it. Candidates are lists of
classes that agree in something. First every class meets the one it agrees most with. Classes in lists
that still hold several components go on if their sizes allow a link: those are dropped that hold too
much that no other component has (``_in_company``), the rest are dealt anew by their rarest elements (``_by_rare_elements``), and meet
some leaders at a time, until no untested pair of different components is left in any list. Tests run
over whole sets: members are routed to their leader, whose text travels once for each run of members,
and a task streams them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.components import components, extended
from panelweave.session import materialize

#: Members up to which a list is one row.
SMALL_LIST = 32
#: After one leader in the first round, those of the second, and how many times more in each next one, at least.
LEADERS, GROWTH = 32, 4
#: Pairs for each class, looked at by a few numbers, up to which a round takes more leaders: few pairs need few rounds.
ROUND_PAIRS = 4096
#: Words of 64 parity bits that a class has.
PARITY = 8
#: Elements whose holders one task counts, and those a task gathers before it sends them there.
PART_ELEMENTS, SENT_ELEMENTS = 2_000_000, 1_000_000
#: Members that meet one copy of their leader.
RUN = 200
#: Keys (16 bytes each) up to which the classes to be read are broadcast.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Measure:
    """The sorted set of a text, and whether two sets are similar. Both run inside tasks."""

    set_of: Callable[[str | None], np.ndarray]
    similar: AtLeast


@dataclass(frozen=True)
class AtLeast:
    """100 times the common elements reach ``percent`` times the elements of both."""

    percent: int

    def __call__(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        if not len(small) or 100 * len(small) < self.percent * len(large):
            return False
        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def class_key(s: np.ndarray) -> int:
    """A number for the set; sets with the same number are taken as equal (64 bits of BLAKE2)."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, body (a hash of the text) and text."""
    column = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(column).alias("body"), column.alias("text"))


def first_row():
    """The row that stands for a class: the smallest id, nulls last, and its text's hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("first")


def _texts(wanted: DataFrame, docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """``wanted`` (key and what goes with it) and the text of each of its classes."""
    chosen = materialize(wanted.join(classes, "key").select(*wanted.columns, F.col("first.doc_id").alias("id"), F.col("first.body").alias("its")), "chosen")
    if chosen.count() <= BROADCAST_KEYS:
        chosen = F.broadcast(chosen)
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("its"))).select(*wanted.columns, "text")
    return texts.dropDuplicates(["key"]) if repeated else texts


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, measure: Measure, repeated: bool) -> DataFrame:
    """The pairs (a, b) whose sets are similar, over the whole texts. ``a`` is the leader of its members b."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(wanted, docs, classes, repeated), "texts")
    large = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RUN).select("a", F.ceil(F.col("n") / RUN).alias("runs"))
    dealt = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("runs", F.lit(1))).alias("run"))
    leaders = dealt.select("a", "run").distinct().join(texts, F.col("a") == F.col("key")).select("a", "run", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    members = dealt.join(texts, F.col("b") == F.col("key")).select("a", "run", F.lit(1).alias("kind"), "b", "text")
    stream = leaders.unionByName(members).repartition("a", "run").sortWithinPartitions("a", "run", "kind")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, its = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, kind, b, text in zip(*(batch[c].to_pylist() for c in ("a", "kind", "b", "text")), strict=True):
                s = measure.set_of(text)
                if not kind:
                    leader, its = a, s
                elif a != leader:
                    raise ValueError(f"class {a} has members but no text")
                elif measure.similar(its, s):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return stream.mapInArrow(tested, "a long, b long")


def _in_company(crowd: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """key and label of the classes of ``crowd`` (key, label, n; ``texts`` has key, label and text) that others with another label may be similar to.

    Similar sets share ``percent`` of 100 elements of either, so a class is dropped that has fewer which
    a class of another component holds. Elements travel as four bytes beside runs of their classes; two
    of equal bytes count as one that is shared, which drops fewer.
    """
    percent = measure.similar.percent
    crowd = _with_label(crowd)
    alone = elements_alone(_with_label(texts), "text", measure.set_of, crowd.agg(F.sum("n")).first()[0])
    return crowd.join(alone, "key", "left").filter(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).select("key", "label")


def elements_alone(held: DataFrame, column: str, set_of: Callable[..., np.ndarray], elements: int) -> DataFrame:
    """key and alone, how many elements no class with another label holds, of ``held`` (key, label, ``column`` that ``set_of`` takes); none has no row."""
    parts = max(1, -(-elements // PART_ELEMENTS))
    sent = held.select("key", "label", column).mapInArrow(_dealer(set_of, parts), "part long, elements binary, keys binary, labels binary, sizes binary")
    counted = sent.groupBy("part").applyInArrow(lambda rows: _alone(rows, parts), "part long, keys binary, alone binary")
    return counted.groupBy("part").applyInArrow(_summed, "key long, alone long")


def _with_label(classes: DataFrame) -> DataFrame:
    """``classes`` with a label; without one each is a component of its own."""
    return classes if "label" in classes.columns else classes.withColumn("label", F.col("key"))


def _stretches(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of equal numbers start and end."""
    if not len(sorted_):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return start, np.r_[start[1:], len(sorted_)]


def _short_numbers(part: np.ndarray, parts: int) -> np.ndarray:
    return part.astype(np.uint16 if parts < 1 << 16 else np.int64)  # these sort faster


def _packed(sets: list[np.ndarray], keys: list[int], labels: list[int], parts: int) -> pa.RecordBatch:
    """One row for each part that has elements: their bytes, and key, key xor label (mostly 0) and size of each run of a class."""
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    part = _short_numbers(whole % np.uint64(parts), parts)
    order = np.argsort(part, kind="stable")
    part, owner, four = part[order], owner[order], (whole[order] >> np.uint64(32)).astype("<u4")
    runs = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])
    ends = np.r_[runs[1:], len(whole)]
    key = np.array(keys, dtype="<i8")
    named, other, sizes = key[owner[runs]], (key ^ np.array(labels, dtype="<i8"))[owner[runs]], (ends - runs).astype("<u4")
    of = part[runs]
    rows = [(int(of[a]), four[runs[a] : ends[b - 1]].tobytes(), named[a:b].tobytes(), other[a:b].tobytes(), sizes[a:b].tobytes()) for a, b in zip(*_stretches(of), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", "elements", "keys", "labels", "sizes"])


def _dealer(set_of: Callable[..., np.ndarray], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, labels, held = [], [], [], 0
        for batch in batches:
            for key, label, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = set_of(value)
                if len(s):
                    sets.append(s)
                    keys.append(key)
                    labels.append(label)
                    held += len(s)
            if held >= SENT_ELEMENTS:
                yield _packed(sets, keys, labels, parts)
                sets, keys, labels, held = [], [], [], 0
        if held:
            yield _packed(sets, keys, labels, parts)

    return dealt


def _numbers(rows: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column].to_pylist()), dtype=kind)


def _alone(rows: pa.Table, parts: int) -> pa.Table:
    """Of a part's ``_packed`` rows: for each part that sums up classes their keys, and how many elements here only their component holds."""
    elements, keys, sizes = _numbers(rows, "elements", "<u4"), _numbers(rows, "keys", "<i8"), _numbers(rows, "sizes", "<u4")
    order = np.argsort(elements, kind="stable")
    elements, label = elements[order], np.repeat(keys ^ _numbers(rows, "labels", "<i8"), sizes)[order]
    start, end = _stretches(elements)
    other = np.r_[False, (elements[1:] == elements[:-1]) & (label[1:] != label[:-1])]
    single = np.empty(len(order), dtype=bool)
    single[order] = np.repeat(~np.logical_or.reduceat(other, start), end - start)
    alone = np.add.reduceat(single, np.r_[0, np.cumsum(sizes, dtype=np.int64)[:-1]], dtype=np.int64)
    some = alone > 0
    keys, alone = keys[some], alone[some].astype("<u4")
    home = _short_numbers(keys % parts, parts)
    order = np.argsort(home, kind="stable")
    home, keys, alone = home[order], keys[order], alone[order]
    sent = [(int(home[a]), keys[a:b].tobytes(), alone[a:b].tobytes()) for a, b in zip(*_stretches(home), strict=True)]
    return pa.table({"part": pa.array([r[0] for r in sent], pa.int64()), "keys": pa.array([r[1] for r in sent], pa.binary()), "alone": pa.array([r[2] for r in sent], pa.binary())})


def _summed(rows: pa.Table) -> pa.Table:
    key, at = np.unique(_numbers(rows, "keys", "<i8"), return_inverse=True)
    return pa.table({"key": key, "alone": np.bincount(at, weights=_numbers(rows, "alone", "<u4"), minlength=len(key)).astype(np.int64)})


def _sets(texts: DataFrame, measure: Measure) -> DataFrame:
    """key, label, n and elements (the set) of ``texts`` (key, label, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure.set_of(text) for text in batch["text"].to_pylist()]
            numbers = [pa.array([len(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], *numbers], ["key", "label", "n", "elements"])

    return texts.mapInArrow(made, "key long, label long, n long, elements array<long>")


def _by_rare_elements(sets: DataFrame, percent: int) -> DataFrame:
    """Lists that hold every similar pair of ``sets`` (key, label, n, elements) with different labels: bucket, key, n, alone, rank and parity words.

    Similar sets share ``percent`` of 100 elements of either. Each class is listed under so many of its
    rarest elements that what is left is less than that share; in one order of all elements two similar
    sets meet there. Elements of one component only (label) come first and make no list. ``alone`` is
    the number of elements that no class of another component holds, each parity bit says whether the
    other ones with one hash are odd in number. The class with the smallest part alone has rank 0 in a list.
    """
    held = materialize(sets.select("key", "label", "n", F.explode("elements").alias("element")), "elements")
    holders = held.groupBy("element").agg(F.count(F.lit(1)).alias("holders"), F.min("label").alias("least"), F.max("label").alias("greatest")).filter("least <> greatest").select("element", "holders")
    bit = F.pmod(F.shiftright("element", 20), F.lit(64 * PARITY))
    words = [F.bit_xor(F.when(F.floor(bit / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(0)).alias(f"bits{w}") for w in range(PARITY)]
    known = held.join(holders, "element").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "element"))).alias("shared"), *words)
    known = known.withColumn("alone", F.col("n") - F.size("shared"))
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - F.col("alone")
    listed = known.withColumn("bucket", F.explode(F.slice("shared", 1, F.greatest(first, F.lit(0)).cast("int"))["element"])).drop("shared")
    order = Window.partitionBy("bucket").orderBy(F.col("alone") / F.col("n"), "key")
    return materialize(listed.withColumn("rank", F.row_number().over(order) - 1), "rare")


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Whether two classes of ``_by_rare_elements`` differ, for all that is known, in few enough elements."""
    odd = sum((F.bit_count(F.col(f"{x}.bits{w}").bitwiseXOR(F.col(f"{y}.bits{w}"))) for w in range(1, PARITY)), F.bit_count(F.col(f"{x}.bits0").bitwiseXOR(F.col(f"{y}.bits0"))))
    shared = F.abs((F.col(f"{x}.n") - F.col(f"{x}.alone")) - (F.col(f"{y}.n") - F.col(f"{y}.alone")))
    apart = F.col(f"{x}.alone") + F.col(f"{y}.alone") + F.greatest(shared, odd)
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _with_others(members: str, percent: int) -> Column:
    """Those of the structs (key, label, n) ``members``, few, that sizes let be similar to one with another label."""

    def may_meet(x: Column, y: Column) -> Column:
        return (x["label"] != y["label"]) & (100 * x["n"] >= percent * y["n"]) & (100 * y["n"] >= percent * x["n"])

    return F.filter(members, lambda x: F.exists(members, lambda y: may_meet(x, y)))


def _sides(df: DataFrame) -> DataFrame:
    return df.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})


def links(
    docs: DataFrame, classes: DataFrame, agreeing: DataFrame, short: DataFrame, long: DataFrame, likely: Callable[[DataFrame], DataFrame], measure: Measure, repeated: bool, promising: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The component (its smallest key) of each class key with a link: node, component.

    Links are similar pairs of a list; those tested connect all that similar pairs of any list connect.
    ``agreeing`` has (a, b, weight): what class b agrees in with list heads a. ``short`` has members,
    ``long`` (bucket, key). ``likely`` keeps the pairs that may be similar; ``classes`` has key and first.
    ``promising`` keeps those of some classes (key, label, n) that have a likely pair among them with another label, and maybe more.
    """

    def test(pairs: DataFrame) -> DataFrame | None:
        held = materialize(likely(pairs), "likely")
        if held.isEmpty():
            return None
        met = materialize(verified(held, docs, classes, measure, repeated), "links")
        return None if met.isEmpty() else met

    best = agreeing.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a"))
    tested = materialize(_sides(best.select("a", "b")), "tested")
    met = test(tested.select("a", "b"))
    label = components(tested.limit(0).select("a", "b") if met is None else met)

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")

    def several(members: DataFrame) -> DataFrame:
        return members.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).filter("least <> greatest").select("bucket")

    percent = measure.similar.percent
    sizes = classes.select("key", "n")
    rows = labelled(short.select(F.xxhash64("members").alias("row"), F.explode("members").alias("key"))).join(sizes, "key")
    lists = rows.groupBy("row").agg(F.collect_list(F.struct("key", "label", "n")).alias("members"), F.min("label").alias("least"), F.max("label").alias("greatest")).filter("least <> greatest")
    left = labelled(long)
    open_keys = lists.select(F.inline(_with_others("members", percent))).select("key", "label").union(left.join(several(left), "bucket").select("key", "label"))
    crowd = materialize(open_keys.distinct().join(sizes, "key"), "crowd")
    if promising:
        crowd = materialize(promising(crowd), "promising")
    if crowd.isEmpty():
        return label
    crowd = materialize(_in_company(crowd, _texts(crowd.select("key", "label"), docs, classes, repeated), measure), "company")
    listed = _by_rare_elements(_sets(_texts(crowd, docs, classes, repeated), measure), percent)
    enough = ROUND_PAIRS * max(1, classes.count())
    low = 0
    while True:
        left = labelled(listed)  # classes of lower ranks have met all others
        open_ = materialize(left.filter(F.col("rank") >= low).join(several(left), "bucket"), "open")
        high, more = _next_rank(open_, low, enough)
        if not more:
            return label
        x, y = open_.filter(F.col("rank") < high).alias("x"), open_.alias("y")
        meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("x.label") != F.col("y.label"))
        pairs = x.join(y, meet & _may_be_similar("x", "y", percent)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        new = _sides(pairs).dropDuplicates(["low", "high"])
        new = materialize(new.join(tested.select("low", "high"), ["low", "high"], "left_anti").select("a", "b", "low", "high"), "more")
        met = test(new.select("a", "b"))
        if met is not None:
            label = extended(label, met)
        if more == "last":
            return label
        tested, low = tested.unionByName(new), high


def _next_rank(open_: DataFrame, low: int, enough: int) -> tuple[int, str]:
    """Rank below which members lead the next round, and "some" or "last" if that leaves some or none, "" if no list is open.

    It is 1, then LEADERS, then GROWTH times ``low``, or after the first as many times more as give no more than ``enough`` pairs.
    """
    start = max(LEADERS, GROWTH * low) if low else 1
    steps = [start * GROWTH**k for k in range(16 if low else 1)]
    ranks = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), *[F.count_if(F.col("rank") < h).alias(f"lead{k}") for k, h in enumerate(steps)], F.max("rank").alias("top"))
    costs = ranks.agg(F.max("top").alias("top"), *[F.sum(F.col("members") * F.col(f"lead{k}")).alias(f"pairs{k}") for k in range(len(steps))]).first()
    if costs["top"] is None:
        return low, ""
    high = max([start, *[h for k, h in enumerate(steps) if costs[f"pairs{k}"] <= enough]])
    return high, "last" if costs["top"] < high else "some"


def component_rows(rows: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of ``rows`` (doc_id, n, key); rows without a set are alone.

    ``label`` has the components of class keys, as ``links`` gives them.

    A component has the smallest doc_id of its rows; null ids never name one that has another.
    """
    named = label.withColumnRenamed("node", "key")  # component: the smallest key
    home = classes.join(named, "key", "left").select("key", "first.doc_id", F.coalesce("component", "key").alias("component"))
    least = home.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    home = home.join(least, "component").select("key", "component_id")
    linked = rows.filter("n > 0").join(home, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
