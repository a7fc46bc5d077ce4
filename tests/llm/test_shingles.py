import random

import numpy as np

from panelweave.llm import jaccard_join, shingles
from panelweave.llm.shingles import shingle_set, word_hashes, words

rng = random.Random(5)


def odd_text():
    short = "".join(rng.choice("aAbBé \t\n\x0b\x0c\r\x1c\x85z") for _ in range(rng.randrange(30)))
    return short + rng.choice(["", "", "x" * rng.randrange(50, 80) + rng.choice(["q", " ", "   " * 40])]) + rng.choice(["", " end"])


def test_a_hash_for_each_word(monkeypatch):
    seen = {}
    for run in (1, 2, 3, 16_384):
        monkeypatch.setattr(shingles, "RUN_WORDS", run)
        for text in [None, "", " ", *(odd_text() for _ in range(1500))]:
            found, hashed = words(text), word_hashes(text)
            assert len(found) == len(hashed)
            assert all(seen.setdefault(w, h) == h for w, h in zip(found, hashed.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) > 2000


def test_new_words_are_not_hashed_one_by_one(monkeypatch):
    monkeypatch.setattr(shingles, "blake2b", None)
    assert len(shingle_set(" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(500)))) == 496


def test_segments_of_sorted_shingles_need_no_sort(monkeypatch):
    s = shingle_set(" ".join(map(str, range(300))))
    nothing = np.zeros(0, dtype=np.uint64)
    monkeypatch.setattr(np, "argsort", None)
    assert all(len(jaccard_join._signatures(s, *role, nothing)) == role[2] for role in jaccard_join.roles(len(s)))


def test_buckets_are_those_of_a_plain_count():
    r = np.random.default_rng(1)
    signatures, keys = r.integers(0, 60, 90).astype("<u4"), r.integers(1, 9, 90)
    plain = {}
    for s, k in zip(signatures.tolist(), keys.tolist(), strict=True):
        plain.setdefault(s, set()).add(k)
    want = sorted(sorted(v) for v in plain.values() if len(v) > 1)
    found = jaccard_join._buckets(signatures, keys, False).to_pylist()
    assert sorted(m for row in found for m in [sorted(set(row["members"]))] * row["weight"]) == want
    often = jaccard_join._buckets(signatures, keys, True).to_pylist()
    assert {row["bucket"]: set(row["members"]) for row in often} == plain
    assert jaccard_join._buckets(np.arange(5, dtype="<u4"), np.arange(5), False).num_rows == 0
    assert jaccard_join._buckets(np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), False).num_rows == 0
