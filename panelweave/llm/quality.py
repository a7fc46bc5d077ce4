"""Quality scores from a sparse ensemble of rules.

Trees grown on labelled rows are taken apart: each path from the root is a rule, a conjunction of
comparisons over a text's statistics. A logistic regression with an absolute-value penalty gives most
rules no weight; the others become one Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.shared import free_name, held_out, small_batches, text_of
from panelweave.session import materialize

#: Labelled rows to learn from, at most: those with the smallest hash of their doc_id.
FIT_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTIES = (0.02, 0.005, 0.001)
THRESHOLD = 0.3
SEED = 17

#: Bytes of signs that prose hardly uses.
SIGNS = np.frombuffer(b"!*&$%#|@^~<>{}[]\\/=+_", dtype=np.uint8)
STATISTICS = (
    "log_words", "word_chars", "signs", "digits", "upper", "upper_words", "points", "other_bytes", "distinct_words", "distinct_pairs",
    "top_word", "doubled", "longest_run", "repeated_lines", "line_words", "longest_line", "worst_signs", "worst_upper", "worst_distinct",
)
#: Words of a stretch; the worst stretch of a text has statistics of its own.
STRETCH = 60


def statistics(text: str) -> tuple[float, ...]:
    """The numbers named in STATISTICS; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = int(by_byte.sum())
    letters = int(by_byte[65:91].sum() + by_byte[97:123].sum()) or 1
    same = np.fromiter(map(eq, words, words[1:]), dtype=bool, count=n - 1)
    breaks = np.flatnonzero(np.r_[True, ~same, True])
    lines = [x for x in text.split("\n") if x.strip()]
    worst = [0.0, 0.0, 1.0]
    for i in range(0, n, STRETCH):
        part = words[i : i + STRETCH]
        if len(part) < STRETCH and n > STRETCH:
            part = words[-STRETCH:]
        joined = "".join(part).encode("utf-8", "replace")
        found = np.bincount(np.frombuffer(joined, dtype=np.uint8), minlength=256)
        worst[0] = max(worst[0], float(found[SIGNS].sum()) / len(joined))
        worst[1] = max(worst[1], float(found[65:91].sum()) / len(joined))
        worst[2] = min(worst[2], len(set(part)) / len(part))
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        float(by_byte[SIGNS].sum()) / size,
        float(by_byte[48:58].sum()) / size,
        float(by_byte[65:91].sum()) / letters,
        sum(map(str.isupper, words)) / n,
        float(by_byte[[44, 46, 58, 59, 63]].sum()) / n,
        float(by_byte[128:].sum()) / size,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        max(Counter(words).values()) / n,
        float(same.sum()) / n,
        float(np.diff(breaks).max()),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        max(map(len, lines)) / len(text),
        *worst,
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([statistics(t) for t in batch])


@dataclass(frozen=True)
class Test:
    """``statistic <= bound``, or ``>`` where ``above``."""

    statistic: int
    above: bool
    bound: float


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class RuleModel:
    """Weights of rules; the score is the logistic function of their sum."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(compile_rule(rule, stats), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def compile_rule(rule: Rule, stats: Column) -> Column:
    """The conjunction as a column expression over the array of statistics."""
    out = F.lit(True)
    for t in rule:
        value = stats[t.statistic]
        out = out & ((value > t.bound) if t.above else (value <= t.bound))
    return out


def _simplified(path: list[Test]) -> Rule:
    """One test at most for each statistic and direction, the narrowest."""
    best: dict[tuple[int, bool], float] = {}
    for t in path:
        k = (t.statistic, t.above)
        best[k] = t.bound if k not in best else (max if t.above else min)(best[k], t.bound)
    return tuple(sorted((Test(s, a, b) for (s, a), b in best.items()), key=lambda t: (t.statistic, t.above)))


def tree_rules(root) -> set[Rule]:
    """A rule for each path from the root of a fitted tree to a node below it."""
    rules: set[Rule] = set()

    def walk(node, path: list[Test]) -> None:
        if path:
            rules.add(_simplified(path))
        if node.subtreeDepth():
            split = node.split()
            for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
                walk(child, [*path, Test(split.featureIndex(), above, split.threshold())])

    walk(root, [])
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text and label (0.0 or 1.0) of at most ``rows`` labelled documents, none of them held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = known.filter(~held_out("doc_id")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers, so every executor can hold them.
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> RuleModel:
    """Rules and weights from a bounded sample of labelled rows; without both labels no rule, score 0.5."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, rows, doc_id, text).select("doc_id", "label", _statistics("text").alias("stats"))
    sample = materialize(sample, "sample").withColumn("features", array_to_vector("stats")).coalesce(4)
    if sample.select("label").distinct().count() < 2:
        return RuleModel(0.0, ())
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.5", seed=SEED).fit(sample)
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode")) for t in forest.trees)), key=str)
    if not rules:
        return RuleModel(0.0, ())
    fired = F.array(*[compile_rule(r, F.col("stats")).cast("double") for r in rules])
    check = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    ruled = materialize(sample.select("label", check.alias("check"), array_to_vector(fired).alias("fired")), "rules").coalesce(4)
    best, least = None, float("inf")
    for penalty in PENALTIES:  # chosen on a fold of the learning rows
        lasso = LogisticRegression(featuresCol="fired", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
        model = lasso.fit(ruled.filter("NOT check"))
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = model.transform(ruled.filter("check")).agg(F.avg(F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p)))).first()[0]
        if loss is not None and loss < least or best is None:
            best, least = lasso, loss if loss is not None else least
    model = best.fit(ruled)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w)
    return RuleModel(float(model.intercept), kept)


def _probability(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


def score(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Whole texts count. A null text is scored as an empty one, whose statistics are all 0. Repeated rows
    are scored each; a null doc_id is never held out; other columns are dropped; an empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    stats = free_name(docs, "stats")
    scored = docs.select(F.col(doc_id).alias("doc_id"), _statistics(text_of(text)).alias(stats))
    value = model.score(F.col(stats))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
