import random

import numpy as np
import pytest

from panelweave.llm import decontamination
from panelweave.llm.decontamination import contaminated, drop_contaminated, partition_of, sketch_plan

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(800)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def plain_set(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, items, share=75):
    sets = [(d, plain_set(t)) for d, t in docs]
    out = set()
    for k, t in items:
        s = plain_set(t)
        out |= {(d, k, len(s), len(s & x)) for d, x in sets if s and 100 * len(s & x) >= share * len(s)}
    return sorted(out, key=str)


def tables():
    items = [(i, " ".join(prose(rng.randint(5, 70)))) for i in range(60)]
    docs = [(i, " ".join(prose(rng.randint(1, 300)))) for i in range(80)]
    for k, t in items:
        w = t.split()
        for lost in (0, len(w) // 12, len(w) // 6, len(w) // 3):  # whole, cut at the end, inside long texts
            docs.append((1000 + len(docs), " ".join(prose(rng.randint(0, 900)) + w[: len(w) - lost] + prose(rng.randint(0, 900)))))
        half = len(w) // 2
        docs.append((1000 + len(docs), " ".join(w[:half] + prose(40) + w[half:])))  # in two places
    common = items[3][1]
    docs += [(5000 + i, f"{i} {common.upper()}\n{i}") for i in range(40)]
    items += [(70, "only four words here"), (71, "Word"), (72, ""), (73, None), (74, " \n"), (3, items[3][1]), (3, "the same id with another text of words"), (None, "an item without any id but words")]
    docs += [(6000, "Only four\twords here"), (6001, "word"), (6002, "a word in it"), (6003, ""), (6004, None), (6005, "x y " * 30_000 + common)]
    docs += [(6006, common), (6006, common), (6006, "a repeated id"), (None, common), (6007, "an item without any id but words")]
    return docs, items


@pytest.mark.parametrize("bound", [decontamination.MAX_BROADCAST, 0])
@pytest.mark.parametrize("share", [75, 100, 40])
def test_matches_brute_force(spark, monkeypatch, bound, share):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", bound)
    docs, items = tables()
    df = spark.createDataFrame([(i, t, 1, "k", -1) for i, t in docs], "doc_id long, text string, n int, item_id string, id int").repartition(3)
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    got = contaminated(df, bench, share)
    assert got.columns == ["doc_id", "item_id", "item_shingles", "held_shingles"]
    want = brute(docs, items, share)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    if share == 75:
        left = drop_contaminated(df, bench)
        assert left.columns == df.columns
        clean = [(i, t) for i, t in docs if not brute([(i, t)], items)]
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs, bench).count() == 1
    assert contaminated(docs.limit(0), bench).count() == contaminated(docs, bench.limit(0)).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == 1
    with pytest.raises(ValueError):
        contaminated(docs, bench, 0)


def test_sketches_cannot_miss():
    r = np.random.default_rng(1)
    for n in range(1, 300):
        low, high = partition_of(n)
        assert low <= n <= high
        kept, hits, least = sketch_plan(n)
        assert 1 <= hits <= kept <= n and least <= -(-75 * n // 100)
        lost = n - -(-75 * n // 100)
        assert kept - lost >= hits
        assert (r.permutation(n)[lost:] < kept).sum() >= hits
