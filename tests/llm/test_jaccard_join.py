import random

import numpy as np
import pytest

from panelweave.llm import jaccard_join, linking
from panelweave.llm.components import components
from panelweave.llm.jaccard_join import _signatures, jaccard_components, near_duplicates_dropped, roles
from panelweave.llm.shingles import shingle_set, words

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def near(w, changes):
    w = list(w)
    for _ in range(changes):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [rng.choice(VOCABULARY)], [w[i], rng.choice(VOCABULARY)]])
    return w


@pytest.mark.parametrize("common_share", [0.0, 0.2, 0.6, 0.9, 1.0])
def test_similar_sets_always_share_a_signature(common_share):
    r = np.random.default_rng(int(common_share * 10))
    for _ in range(400):
        n = int(r.integers(1, 90))
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[r.random(n) > r.random() * 0.25], r.integers(0, 2**63, int(n * r.random() * 0.3), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        nothing = np.zeros(0, dtype=np.uint64)
        seen = np.concatenate([_signatures(x, *role, nothing, every=True) for x in (a, b) for role in roles(len(x))])
        common = np.sort(seen[r.random(len(seen)) < common_share])
        mine, theirs = (np.concatenate([_signatures(x, *role, common) for role in roles(len(x))]) for x in (a, b))
        assert len(np.intersect1d(mine, theirs)), (len(a), len(b), both)


def plain_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    texts = [" ".join(prose(rng.randint(1, 120))) for _ in range(150)]
    for _ in range(12):  # groups of near copies, some of them chains
        w = prose(rng.randint(6, 200))
        for _ in range(rng.randint(2, 12)):
            texts.append(" ".join(w))
            base = near(w, max(1, len(w) // rng.randint(30, 90)))
            w = base if rng.random() < 0.5 else w
            texts.append(" ".join(base))
    passage = prose(60)
    for _ in range(60):  # one passage in many texts
        a = rng.randint(3, 60)
        texts.append(" ".join(prose(a) + passage + prose(rng.randint(3, 60))))
    for _ in range(40):  # mostly the passage
        texts.append(" ".join(near(passage, rng.randint(0, 3)) + prose(rng.randint(0, 12))))
    texts += ["One two", "one  TWO", "ONE\ttwo\n", "one two three", "É a b c d e", "é a b c d e", "", None, " \n", "x " * 20_000, "x " * 20_001]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # all roads: many parts, common segments, chunks and large buckets
        for name, value in (("PART_SIGNATURES", 500), ("COMMON_TIMES", 3), ("CHUNK", 7), ("SPREAD", 3), ("SEEN", 5)):
            monkeypatch.setattr(jaccard_join, name, value)
        for name, value in (("SMALL_LIST", 4), ("LEADERS", 8), ("ROUND_PAIRS", 1), ("RUN", 3), ("BROADCAST_KEYS", 0)):
            monkeypatch.setattr(linking, name, value)
    rows = [(i * 3 + 5, t) for i, t in enumerate(corpus())] + [(8, "one two three"), (8, "repeated id"), (None, "one two"), (None, "only null id")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(4)
    got = sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)
    assert got == brute(rows)
    left = near_duplicates_dropped(df)
    assert left.columns == df.columns
    want = [i for i, _, c in brute(rows) if i is None or i == c]
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).collect() == []
    assert jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].component_id == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys((500, 501, 502), 500)}


def test_sets():
    assert len(shingle_set("a b c d e f a b c d e")) == 6 and len(shingle_set("A")) == 1 and np.array_equal(shingle_set("a B"), shingle_set("A b"))
    assert len(shingle_set("a b")) == 1 and not len(shingle_set(None))
