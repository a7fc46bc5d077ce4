"""Exact ranks and quantiles without gathering a group in one task.

A group is counted per distinct value and cut into value ranges; each range is
ranked on its own with the row counts of the ranges below added in front. The
cut points come from a hash-chosen sample of the distinct values, so they only
balance the work and are the same however often and in whatever order tasks
run. A group with a third of all rows is spread over its ranges instead of
being sorted in one place; the join that hands out the cut points is salted
for the same reason.

Quantiles need ranks only near their places: sketches bracket each one, and only the values inside a bracket
are ranked.

The counts are stored first: several branches of the plan read them, and a
value recomputed from a floating sum could differ in its last bit between
branches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.session import materialize

RANGES = 64
SALTS = 16
SAMPLE = 1024
#: Accuracy of the sketches that bracket quantiles, the half width of a bracket in units of their error,
#: and how many times wider one is made that missed.
ACCURACY = 2_000
MARGIN = 2.0
WIDEN = 16


def _range_of(value: str, ranges: int, passed: bool = False) -> Column:
    """How many of the sorted ``_cuts``, fewer than ``ranges``, a value has reached or, if ``passed``, left behind.

    A binary search in a loop keeps the expression small, whatever the number of ranges.
    """
    steps = [1 << k for k in reversed(range((ranges - 1).bit_length()))]
    v = F.col(f"`{value}`")

    def taken(at: Column, step: Column) -> Column:
        cut = F.get("_cuts", at + step - 1)
        return F.when(cut < v if passed else cut <= v, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), taken) if steps else F.lit(0)


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES, weight: str | None = None
) -> DataFrame:
    """(keys, value, n, below, total): multiplicity, rows smaller, rows in the group.

    Nulls are skipped, and so are rows with a missing key. ``weight`` names a count column of an already folded
    table. Runs one job, which stores the counts per distinct value.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("n"))
    counts = materialize(counts, "value-counts")
    slot = F.pmod(F.xxhash64(value), F.lit(SAMPLE)).alias("_slot")
    picked = counts.groupBy(*keys, slot).agg(
        F.min(F.struct(F.xxhash64(F.col(value), F.lit(7)).alias("h"), F.col(value).alias("v"))).alias("_p"), F.sum("n").alias("_n")
    )
    sample = picked.groupBy(*keys).agg(F.sort_array(F.collect_list("_p.v")).alias("_s"), F.sum("_n").alias("total"))
    marks = f"transform(sequence(1, {ranges - 1}), i -> get(_s, CAST(floor(i * size(_s) / {ranges}) AS INT)))"
    cuts = sample.select(*keys, F.expr(marks).alias("_cuts"), "total")
    if keys:
        salted = counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
        copies = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        cut = salted.join(copies, [*keys, "_salt"], "inner").drop("_salt")
    else:
        # one row of cut points for the whole table: a broadcast of 64 numbers
        one = F.broadcast(cuts.withColumn("_salt", F.lit(0).cast("bigint")))
        cut = counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(1))).join(one, "_salt", "inner").drop("_salt")
    cut = cut.withColumn("_range", _range_of(value, ranges)).drop("_cuts")
    before = W.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_range").agg(F.sum("n").alias("_m"))
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return cut.join(offsets, [*keys, "_range"], "inner").select(
        *keys,
        value,
        "n",
        (F.col("_off") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"),
        "total",
    )


def _marks(p: float, margin: float, accuracy: int) -> tuple[float, float]:
    """Shares between which the sketch looks for the quantile; beyond 0 and 1 the bracket is open."""
    return p - margin / accuracy, p + margin / accuracy


def _inside(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], margin: float, accuracy: int) -> DataFrame:
    """(keys, _total, _at, _value, _n): for each quantile the values in its bracket, counted.

    Rows below a bracket are counted under a null value; rows above it are left out. The first pass merges
    sketches and stores the brackets, the second counts with map-side combining. What it shuffles is the few
    values that lie in a bracket.
    """
    marks = [_marks(p, margin, accuracy) for p in probs]
    asked = sorted({m for pair in marks for m in pair if 0 < m < 1})
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    size = F.count(F.lit(1)).alias("_total")
    edges = [F.percentile_approx(value, asked, accuracy).alias("_edges")] if asked else []
    brackets = materialize(known.groupBy(*keys).agg(size, *edges).withColumn("_one", F.lit(0)), "brackets")
    # Without keys this is one row; with keys one row a group, and adaptive execution splits hot groups.
    one = brackets if keys else F.broadcast(brackets)
    near = known.withColumn("_one", F.lit(0)).join(one, ["_one", *keys])

    def edge(mark: float) -> Column | None:
        return F.col("_edges")[asked.index(mark)] if 0 < mark < 1 else None

    cells = []
    for at, (low, high) in enumerate(marks):
        lo, hi = edge(low), edge(high)
        v = F.col(value)
        use = F.lit(True) if hi is None else v <= hi
        kept = v if lo is None else F.when(v >= lo, v)
        cells.append(F.when(use, F.struct(F.lit(at).alias("_at"), kept.alias("_value"))))
    rows = near.select(*keys, "_total", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("_c"))
    return rows.select(*keys, "_total", "_c.*").groupBy(*keys, "_total", "_at", "_value").agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int = ACCURACY, margin: float = MARGIN) -> DataFrame:
    """Exact interpolated quantiles per group, one column per name in ``probs``.

    Two passes over the column: mergeable sketches give a bracket around each quantile, then the rows below it
    are counted and the values inside it ranked by ``ranked_values``. A bracket that misses its quantile in any
    group is widened and that pass repeated, in the end over all values, so the result is exact whatever the
    sketch gives. Nulls and rows with a missing key are skipped; a group without values has no row, a whole
    table without values one of nulls. Runs jobs.
    """
    shares = [float(p) for p in probs.values()]
    while True:
        cells = materialize(_inside(df, keys, value, shares, margin, accuracy), "inside")
        below = F.coalesce(F.sum(F.when(F.col("_value").isNull(), F.col("_n"))), F.lit(0)).alias("_below")
        inside = F.coalesce(F.sum(F.when(F.col("_value").isNotNull(), F.col("_n"))), F.lit(0)).alias("_in")
        share = F.element_at(F.array(*[F.lit(p) for p in shares]), F.col("_at") + 1)
        pos = (F.col("_total") - 1) * share
        parts = cells.groupBy(*keys, "_total", "_at").agg(below, inside).withColumn("_pos", pos)
        hit = (F.col("_below") <= F.floor("_pos")) & (F.ceil("_pos") < F.col("_below") + F.col("_in"))
        if margin >= accuracy or parts.filter(~hit).isEmpty():
            break
        margin *= WIDEN
    ranked = ranked_values(cells, [*keys, "_at"], "_value", weight="_n").withColumnRenamed("total", "_ranked")
    placed = ranked.join(parts, [*keys, "_at"])
    first = F.col("_below") + F.col("below")

    def holds(k: Column) -> Column:
        return F.max(F.when((first <= k) & (k < first + F.col("n")), F.col("_value")))

    ends = placed.groupBy(*keys, "_at", "_pos").agg(holds(F.floor("_pos")).alias("_lo"), holds(F.ceil("_pos")).alias("_hi"))
    each = ends.select(*keys, "_at", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias("_q"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_at") == at, F.col("_q"))).alias(name) for at, name in enumerate(probs)])


def rank_cuts(df: DataFrame, keys: Sequence[str], values: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(keys, _cuts_<value>): stored cut points between ranges of each column's values in a group, by sketches, in one pass."""
    marks = [i / ranges for i in range(1, ranges)]
    return materialize(df.groupBy(*keys).agg(*[F.percentile_approx(v, marks, ACCURACY).alias(f"_cuts_{v}") for v in values]), "cuts")


def with_average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, tie: str, name: str, ranges: int = RANGES, cuts: DataFrame | None = None
) -> DataFrame:
    """``df`` with the rank of ``value`` in its group as ``name``; ties share their average rank.

    A row stands for ``weight`` equal ones. Sketches give the cut points. A value that a third of the rows have
    is several cut points at once, and its rows are dealt over the ranges between them by a hash of ``tie``;
    what the ranges of a value have in common is settled on one summary row per range. Ranks stay with their
    rows: nothing is joined on values. ``value`` and the keys are not null. Stores the cut points, the rows
    with their place in a range, and the summaries (runs jobs). ``cuts`` are those of ``rank_cuts`` over rows with
    the same values, if they are known.
    """
    if cuts is None:
        cuts = rank_cuts(df, keys, [value], ranges)
    cuts = cuts.select(*keys, F.col(f"_cuts_{value}").alias("_cuts"))
    passed, reached = _range_of(value, ranges, passed=True), _range_of(value, ranges)
    dealt = passed + F.pmod(F.xxhash64(tie), reached - passed + 1)
    cut = df.join(cuts, list(keys)).withColumn("_range", dealt.cast("int"))
    inside = W.partitionBy(*keys, "_range")
    ranked = cut.drop("_cuts").withColumns(
        {"_upto": F.sum(weight).over(inside.orderBy(value)), "_ties": F.sum(weight).over(W.partitionBy(*keys, "_range", value))}
    )
    ranked = materialize(ranked, "ranges")
    ends = ranked.groupBy(*keys, "_range").agg(
        F.sum(weight).alias("n"), F.min(F.struct(F.col(value).alias("v"), F.col("_ties").alias("w"))).alias("first"), F.max(F.struct(F.col(value).alias("v"), F.col("_ties").alias("w"))).alias("last")
    )
    each = ends.groupBy(*keys).agg(F.collect_list(F.struct("_range", "n", "first", "last")).alias("_all"))

    def total(part) -> Column:
        return F.aggregate("_all", F.lit(0).cast("long"), lambda s, r: s + part(r))

    def below(v: Column) -> Column:
        """Rows of the group below ``v``, the first or last value of a range."""
        return total(lambda r: F.when(r["last"]["v"] < v, r["n"]).when((r["first"]["v"] < v) & (r["last"]["v"] == v), r["n"] - r["last"]["w"]).otherwise(0))

    def ties(v: Column) -> Column:
        return total(lambda r: F.when(r["first"]["v"] == v, r["first"]["w"]).when(r["last"]["v"] == v, r["last"]["w"]).otherwise(0))

    one = each.select(*keys, "_all", F.explode("_all").alias("_r"))
    first, last = F.col("_r.first.v"), F.col("_r.last.v")
    start = total(lambda r: F.when(r["_range"] < F.col("_r._range"), r["n"]).otherwise(0))
    summary = one.select(
        *keys, F.col("_r._range").alias("_range"), start.alias("_start"), first.alias("_first"), last.alias("_last"),
        below(first).alias("_first_below"), ties(first).alias("_first_ties"), below(last).alias("_last_below"), ties(last).alias("_last_ties"),
    )
    at = ranked.join(materialize(summary, "summary"), [*keys, "_range"])
    v = F.col(value)
    lower = F.when(v == F.col("_first"), F.col("_first_below")).when(v == F.col("_last"), F.col("_last_below")).otherwise(F.col("_start") + F.col("_upto") - F.col("_ties"))
    equal = F.when(v == F.col("_first"), F.col("_first_ties")).when(v == F.col("_last"), F.col("_last_ties")).otherwise(F.col("_ties"))
    return at.select(*[F.col(f"`{c}`") for c in df.columns], (lower + (equal + 1) / F.lit(2.0)).alias(name))
