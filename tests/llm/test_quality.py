import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.llm import quality
from panelweave.llm.quality import STATISTICS, RuleModel, Test, fit, labelled_sample, score, statistics
from panelweave.llm.shared import held_out

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]


def text(good):
    words = [rng.choice(WORDS) for _ in range(rng.randint(20, 150))]
    if not good:
        words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, text(i % 4 > 0), "en", 1.0) for i in range(700)]
    docs = spark.createDataFrame([*rows, (9000, None, "en", 0.0), (9001, "", "en", 0.0), (None, "no id", "en", 0.0), (9002, "w " * 60_000, "en", 0.0), (9002, "w " * 60_000, "en", 0.0)], "doc_id long, text string, stats string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(700)] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache()


def test_held_out_accuracy_and_edges(spark, data):
    docs, labels = data
    model = fit(docs, labels)
    assert model.weights
    rows = score(docs, model).collect()
    assert len(rows) == 705 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = [r.predicted == (r.doc_id % 4 > 0) for r in rows if r.held_out and r.doc_id < 700]
    assert len(right) > 90 and sum(right) / len(right) > 0.97
    assert score(docs.limit(0), model).collect() == []


def test_only_learning_rows_are_sampled(spark, data):
    docs, labels = data
    sample = labelled_sample(docs, labels, "quality", 50)
    assert sample.count() == 50 and sample.filter(held_out()).count() == 0
    assert labelled_sample(docs, labels, "quality", 50).exceptAll(sample).count() == 0


def test_rules_are_the_paths(spark):
    model = RuleModel(-1.0, (((Test(0, True, 1.0), Test(1, False, 2.0)), 3.0), ((Test(2, True, 0.5),), -4.0)))
    df = spark.createDataFrame([([a, b, c],) for a in (1.0, 2.0) for b in (2.0, 3.0) for c in (0.0, 1.0)], "s array<double>")
    for r in df.select("s", model.score(F.col("s")).alias("p")).collect():
        z = -1 + 3 * (r.s[0] > 1 and r.s[1] <= 2) - 4 * (r.s[2] > 0.5)
        assert math.isclose(r.p, 1 / (1 + math.exp(-z)))


def test_without_labels(spark, data):
    docs, labels = data
    for none in (labels.limit(0), labels.filter("quality = 1")):
        model = fit(docs, none)
        assert model == RuleModel(0.0, ())


def test_statistics():
    assert len(statistics("a b")) == len(statistics("")) == len(STATISTICS)
    named = dict(zip(STATISTICS, statistics("A A A\nb! c"), strict=True))
    assert named["longest_run"] == 3 and named["doubled"] == 0.4 and named["top_word"] == 0.6 and named["repeated_lines"] == 0
    assert quality.statistics("\ud800 x")
