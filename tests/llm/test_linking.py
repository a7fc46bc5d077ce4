import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from panelweave.llm import bottom_k, jaccard_join, linking

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]


def text(base, changes):
    """``base`` with other words at so many places that lie apart, so that each takes other shingles."""
    w = list(base)
    for i in rng.sample(range(4, len(w) - 4, 6), changes):
        w[i] = rng.choice(VOCABULARY) + str(rng.randrange(10**6))
    return " ".join(w)


OPERATORS = [(jaccard_join, jaccard_join.jaccard_components, 5), (bottom_k, bottom_k.near_duplicates, 3)]


@pytest.mark.parametrize(("module", "operator", "size"), OPERATORS)
def test_texts_that_share_much_but_too_little_are_not_paired(spark, monkeypatch, module, operator, size):
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = [(i, text(base, rng.randint(5, 7))) for i in range(300)]
    met, real = [], module._likely
    monkeypatch.setattr(module, "_likely", lambda pairs, classes: met.append(pairs.count()) or real(pairs, classes))
    got = {r.doc_id: r.component_id for r in operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i for i, _ in rows}
    assert sum(met) <= 2 * len(rows)  # 44,850 pairs agree in something


@pytest.mark.parametrize(("module", "operator", "size"), OPERATORS)
def test_similar_classes_meet_in_a_list(spark, monkeypatch, module, operator, size):
    monkeypatch.setattr(linking, "PART_ELEMENTS", 300)
    monkeypatch.setattr(linking, "SENT_ELEMENTS", 500)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    for n in (1, 3, 6, 20, 90, 150):
        base = [rng.choice(VOCABULARY) for _ in range(n)]
        texts += [text(base, rng.randint(0, n // 40)) if n > 9 else " ".join(base + [rng.choice("xyz")] * rng.randint(0, 3)) for _ in range(20)]
    sets = {linking.class_key(s): s for s in map(module.set_of if size == 3 else module.shingle_set, texts)}
    by_key = {linking.class_key(module.MEASURE.set_of(t)): t for t in texts}
    similar = {(a, b) for a in sets for b in sets if a < b and module.MEASURE.similar(sets[a], sets[b])}
    assert len(similar) > 50
    crowd = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "key long, n long")
    held = spark.createDataFrame(list(by_key.items()), "key long, text string").repartition(3)
    near = linking._in_company(crowd, held, module.MEASURE)
    left = {r.key for r in near.collect()}
    assert left >= {k for pair in similar for k in pair} and len(left) < len(sets)
    listed = linking._by_rare_elements(linking._sets(held.join(near, "key"), module.MEASURE), module.PERCENT)
    x, y = listed.alias("x"), listed.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")) & linking._may_be_similar("x", "y", module.PERCENT))
    assert {(r.a, r.b) for r in pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct().collect()} >= similar


@pytest.mark.parametrize("parts", [1, 7, 700])
def test_elements_that_one_component_holds(parts):
    r = np.random.default_rng(parts)
    sets = [np.unique(r.integers(0, 2**64 - 1, r.integers(1, 60), dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.r_[sets[i][::2], sets[i * 7 % 40][::3]]) for i in range(40)]
    keys = [int(k) for k in r.integers(-(2**62), 2**62, 80)]
    labels = [keys[i - 40] if i >= 40 and i % 3 else keys[i] for i in range(80)]
    rows = pa.Table.from_batches([linking._packed(sets[a:b], keys[a:b], labels[a:b], parts) for a, b in ((0, 30), (30, 80))])

    def by_part(rows):
        return [rows.filter(pc.equal(rows["part"], p)) for p in rows["part"].unique()]

    sent = pa.concat_tables([linking._alone(x, parts) for x in by_part(rows)])
    got = [row for x in by_part(sent) for row in linking._summed(x).to_pylist()]
    labels_of = {}
    for s, label in zip(sets, labels, strict=True):
        for e in s.tolist():
            labels_of.setdefault(e, set()).add(label)
    alone = {k: sum(len(labels_of[e]) == 1 for e in s.tolist()) for k, s in zip(keys, sets, strict=True)}
    assert {row["key"]: row["alone"] for row in got} == {k: n for k, n in alone.items() if n}
    assert len(got) == len({row["key"] for row in got})


@pytest.mark.parametrize(("module", "operator", "size"), OPERATORS)
def test_copies_of_one_component_only_are_no_company(spark, module, operator, size):
    linked, apart = ([rng.choice(VOCABULARY) for _ in range(150)] for _ in range(2))
    texts = [text(linked, 2), text(linked, 2), text(apart, 2), text(apart, 2)]
    sets = [module.MEASURE.set_of(t) for t in texts]
    keys = [linking.class_key(s) for s in sets]
    labels = [keys[0], keys[0], keys[2], keys[3]]
    crowd = spark.createDataFrame([(k, c, len(s)) for k, c, s in zip(keys, labels, sets, strict=True)], "key long, label long, n long")
    held = spark.createDataFrame(list(zip(keys, labels, texts, strict=True)), "key long, label long, text string")
    near = linking._in_company(crowd, held, module.MEASURE)
    assert {r.key for r in near.collect()} == {*keys[2:]}
    listed = linking._by_rare_elements(linking._sets(held, module.MEASURE), module.PERCENT)
    assert {r.key for r in listed.collect()} == {*keys[2:]}


def test_members_of_short_lists_go_on_with_one_that_sizes_allow(spark):
    members = [(1, 1, 100), (2, 2, 85), (3, 3, 70), (4, 1, 84), (5, 4, 200), (6, 4, 199), (7, 1, 8)]
    row = spark.createDataFrame([(members,)], "members array<struct<key: long, label: long, n: long>>")
    found = row.select(F.inline(linking._with_others("members", 85)))
    assert {r.key for r in found.collect()} == {1, 2, 4}
