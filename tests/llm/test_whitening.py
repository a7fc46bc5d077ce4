import numpy as np
import pytest

from panelweave.llm import whitening
from tests.conftest import SF


def brute(rows, k):
    """n, deviations, whitened rows (up to sign), shares and error, with numpy alone."""
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    apart = (n * x - sums).astype(object)
    w = ((n * x - sums) / n) @ axes / np.sqrt(values)
    return n, [int((r * r).sum()) for r in apart], w, values / np.trace(cov)


def check(spark, ids, rows, k):
    df = spark.createDataFrame(list(zip(ids, [[float(c) for c in v] for v in rows], ids, strict=True)), "vec_id long, embedding array<float>, row_no long").repartition(3)
    rows = [np.array(v, dtype=np.float32) for v in rows]
    got = whitening.whiten(df, whitening.fit(df, k)).orderBy("vec_id", "component").collect()
    n, deviation, w, shares = brute(rows, k)
    assert len(got) == len(rows) * k
    found = np.array([r.whitened for r in got]).reshape(-1, k)
    order = np.argsort(ids)
    sign = np.sign((found * w[order]).sum(axis=0))
    assert np.allclose(found * sign, w[order], atol=1e-8)
    assert [int(r.deviation) for r in got[::k]] == [deviation[i] for i in order]
    assert {r.n for r in got} == {n} and np.allclose([r.explained for r in got[:k]], shares, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("blocks", [False, True])
def test_matches_numpy(spark, monkeypatch, blocks):
    if blocks:  # several blocks and slabs
        for name, value in (("BLOCK_ENTRIES", 70), ("SLAB_BLOCKS", 4), ("TASK_BLOCKS", 2)):
            monkeypatch.setattr(whitening, name, value)
    r = np.random.default_rng(5)
    rows = r.normal(size=(90, 7)) @ r.normal(size=(7, 7)) * 3
    rows = np.vstack([rows, np.repeat(rows[:1], 60, axis=0), rows[5:8]])  # a vector in a third of the rows
    check(spark, list(r.permutation(len(rows)).tolist()), rows, 5)


def test_a_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check(spark, [v.vec_id for v in df], [v.embedding for v in df], 16)


def test_odd_rows(spark):
    schema = "vec_id string, embedding array<float>, whitened int"
    nan, inf = float("nan"), float("inf")
    good = [("a", [1.0, 2.0], 1), ("b", [3.0, -1.0], 1), (None, [0.5, 0.25], 1), ("a", [1.0, 2.0], 1)]
    bad = [("c", None, 1), ("d", [], 1), ("e", [1.0, None], 1), ("f", [nan, 1.0], 1), ("g", [-inf, 1.0], 1)]
    df = spark.createDataFrame(good + bad, schema)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["None"] * 2 + ["a"] * 4 + ["b"] * 2 and {r.n for r in got} == {3}
    for few in (df.limit(0), df.filter("vec_id = 'a'"), df.filter("vec_id = 'c'")):
        assert whitening.whiten(few, whitening.fit(few)).collect() == []
    line = spark.createDataFrame([(str(i), [float(i), 2.0 * i], 0) for i in range(5)], schema)
    assert {r.component for r in whitening.whiten(line, whitening.fit(line)).collect()} == {1}  # the other has no spread
    with pytest.raises(ValueError, match="between 1 and 2"):
        whitening.fit(spark.createDataFrame([("a", [1.0], 0), ("b", [1.0, 2.0], 0)], schema))
