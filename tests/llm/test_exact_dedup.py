import hashlib
import re

from pyspark.sql import functions as F

from panelweave.llm.exact_dedup import ExactDedup


def brute(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in texts.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "x" * 50000), (8, "x" * 50000), (6, "é"), (6, "é"), (None, "a b"), (11, "unique"), (12, "a b")]


def write(spark, path, rows, mode="append"):
    spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, digest string, n int").write.mode(mode).parquet(path)


def test_matches_brute_force_and_goes_on_from_its_state(spark, tmp_path):
    path = str(tmp_path / "docs")
    write(spark, path, ROWS[:6])
    dedup = ExactDedup(spark, str(tmp_path / "state"), batch_bytes=1000)
    dedup.absorb(path)
    assert rows_of(dedup.report(path)) == brute(ROWS[:6])
    write(spark, path, ROWS[6:])
    again = ExactDedup(spark, str(tmp_path / "state"), batch_bytes=1000)
    again.absorb(path)
    out = again.report(path)
    assert rows_of(out) == brute(ROWS)
    assert out.filter("kept").count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})


def test_equal_digests_of_different_texts(spark, tmp_path):
    path = str(tmp_path / "docs")
    write(spark, path, ROWS)
    weak = ExactDedup(spark, str(tmp_path / "state"), digest=lambda c: (F.length(c) % 2).cast("string"))
    weak.absorb(path)
    out = weak.report(path)
    assert rows_of(out) == brute(ROWS)
    assert out.filter("kept").count() == len({h for *_, h in brute(ROWS)})


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs")
    write(spark, path, [])
    dedup = ExactDedup(spark, str(tmp_path / "state"))
    dedup.absorb(path)
    assert dedup.report(path).collect() == []
