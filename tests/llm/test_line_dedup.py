import pytest
from pyspark.sql import Row

from panelweave.llm import line_dedup
from panelweave.llm.line_dedup import drop_shared_lines

SCHEMA = "doc_id long, text string, source string, n_chars long, line string, removed string"


def brute(rows, least):
    sites, first = {}, {}
    for i, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            line = line.strip(" ")
            if line:
                sites.setdefault(line, set()).add(s)
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    bad = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None))
            continue
        out.append((i, "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad or first.get(x.strip(" ")) == i)))
    return sorted(out, key=str)


ROWS = (
    [(i, f"own {i}\n  cookie banner \n\nshared by {i % 3}", f"s{i % 12}", 5, "z", None) for i in range(60)]
    + [(100, None, "s1", None, "z", None), (101, "", None, 0, "z", None), (None, "cookie banner\nmine", None, 1, "z", None)]
    + [(102, "cookie banner", "s3", 1, "z", None)] * 3
    + [(103, "\n".join(["again"] * 50 + ["x" * 90_000]), "s4", 1, "z", None)]
    + [(200 + i, f"edge line\nnine line {'a' if i < 9 else 'b'}", f"t{i}", 1, "z", None) for i in range(10)]
)


@pytest.mark.parametrize("least", [3, 10, 12])
def test_matches_brute_force(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = drop_shared_lines(df, least, removed="gone")
    assert out.columns == [*df.columns, "gone"]
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == brute(ROWS, least)
    assert all(r.n_chars == len(r.text) for r in rows if r.gone)


def test_sketches_decide_far_from_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SIGMAS", 0)
    rows = [Row(doc_id=i, text="many" if i < 60 else "few" if i < 63 else f"u{i}", source=f"s{i}") for i in range(80)]
    out = drop_shared_lines(spark.createDataFrame(rows), 20)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(r.doc_id, "" if 0 < r.doc_id < 60 else r.text) for r in rows]


def test_empty(spark):
    assert drop_shared_lines(spark.createDataFrame([], SCHEMA)).collect() == []
