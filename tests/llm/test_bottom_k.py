import random
import time

import numpy as np
import pytest

from panelweave.llm import bottom_k, linking
from panelweave.llm.bottom_k import least_shared, may_be_similar, near_duplicates, near_duplicates_dropped
from panelweave.llm.shingles import words
from tests.conftest import SF
from tests.llm.test_jaccard_join import corpus, near, prose

rng = random.Random(5)


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= 85 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, None if d is None or c is None else d == c))
    return sorted(out, key=str)


def test_estimate():
    assert least_shared(64) < 0.85 * 64 and least_shared(0) == 0
    r = np.random.default_rng(1)
    kept = dropped = 0
    for _ in range(500):
        n = int(r.integers(1, 400))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[r.random(n) > r.random() * 0.5], r.integers(0, 2**63, int(n * r.random() * 0.3), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b):
            continue
        similar = linking.AtLeast(85)(a, b)
        both = len(np.intersect1d(a, b))
        assert similar == (100 * both >= 85 * (len(a) + len(b) - both))
        guess = may_be_similar(a[:64], len(a), b[:64], len(b))
        assert guess or not similar
        kept += similar
        dropped += not guess
    assert kept > 20 and dropped > 100


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # all roads: common values, long lists, several runs of a leader
        for module, name, value in ((bottom_k, "COMMON_SETS", 3), (linking, "SMALL_LIST", 3), (linking, "LEADERS", 8), (linking, "ROUND_PAIRS", 1), (linking, "RUN", 3), (linking, "BROADCAST_KEYS", 0), (bottom_k, "SEEN", 5)):
            monkeypatch.setattr(module, name, value)
    texts = corpus()
    base = prose(150)
    texts += [" ".join(near(base, rng.randint(1, 4))) for _ in range(70)]  # a large group of near copies
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)] + [(8, "one two three"), (8, "repeated id"), (None, "one two"), (None, "only null id"), (None, "only null id")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, key string, n int, gone int").repartition(4)
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == brute(rows)
    if small:
        left = near_duplicates_dropped(df)
        assert left.columns == df.columns
        assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, _, c, _ in brute(rows) if i is None or i == c), key=str)


def test_a_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].kept


def test_many_common_values_are_searched_once_for_all_sets():
    r = np.random.default_rng(2)
    common = np.unique(r.integers(-(2**63), 2**63 - 1, 200_000))
    sketches = [np.concatenate([r.choice(common, 64 - k), r.integers(-(2**63), 2**63 - 1, k)])[: r.integers(1, 65)] for k in r.integers(0, 65, 2000)]
    began = time.process_time()
    got = bottom_k._retained(sketches, common)
    assert time.process_time() - began < 5  # a pass over the common values for each set takes a minute
    known = set(common.tolist())
    for sketch, values in zip(sketches, got, strict=True):
        rare = [v for v in sketch.tolist() if v not in known]
        few = len(rare) < min(bottom_k.LISTED, len(sketch))
        assert values.tolist() == (sorted({*rare, *sketch[: bottom_k.LISTED].tolist()}) if few else rare[: bottom_k.LISTED])
    assert [v.tolist() for v in bottom_k._retained(sketches[:3], common[:0])] == [s[: bottom_k.LISTED].tolist() for s in sketches[:3]]


def test_promising_classes_have_every_likely_pair(spark):
    least = [least_shared(k) for k in range(bottom_k.SKETCH + 1)]
    assert least == sorted(least)
    texts = corpus() + [" ".join(near(base, rng.randint(0, 9))) for base in [prose(n) for n in (5, 30, 66, 90, 200)] for _ in range(6)]
    sets = {linking.class_key(s): s for s in map(bottom_k.set_of, texts) if len(s)}
    label = {k: k if rng.random() < 0.7 else 1 for k in sets}
    may = lambda a, b: may_be_similar(sets[a][:64], len(sets[a]), sets[b][:64], len(sets[b]))
    likely = {k for a in sets for b in sets if label[a] != label[b] and may(a, b) for k in (a, b)}
    crowd = spark.createDataFrame([(k, label[k], len(s)) for k, s in sets.items()], "key long, label long, n long")
    classes = spark.createDataFrame([(k, s[:64].view(np.int64).tolist()) for k, s in sets.items()], "key long, sketch array<long>")
    left = {r.key for r in bottom_k._promising(crowd, classes).collect()}
    assert likely and left >= likely and len(left) < len(sets)
    assert bottom_k._promising(crowd.limit(0), classes).collect() == []
