import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelweave.llm import line_dedup, toxicity
from panelweave.llm.queries import word_bpe
from panelweave.session import materialize
from tests.conftest import SF
from tests.llm.test_decontamination import brute as held_items
from tests.llm.test_jaccard_join import brute as components

rng = random.Random(3)


def plain_lines(docs):
    sites, first = {}, {}
    for d in docs:
        for line in (d.text or "").split("\n"):
            k = line.strip(" ")
            if k:
                sites.setdefault(k, set()).add(d.source)
                if d.doc_id is not None:
                    first[k] = min(first.get(k, d.doc_id), d.doc_id)
    shared = {k for k, v in sites.items() if len(v) >= line_dedup.MIN_SITES}
    return [(d.doc_id, d.text if d.text is None else "\n".join(x for x in d.text.split("\n") if x.strip(" ") not in shared or first.get(x.strip(" ")) == d.doc_id)) for d in docs]


def key(rows):
    return sorted(rows, key=str)


def test_every_stage_against_a_plain_version(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, top = docs.schema, docs.agg({"doc_id": "max"}).first()[0]
    prose = [w for r in docs.limit(20).collect() for w in (r.text or "").split()][:2000]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    more = []
    for i in range(40):  # a line on 12 sources, near copies and leaks, nulls and empties
        body = " ".join(rng.choice(prose) for _ in range(80))
        more += [body + "\nSubscribe to all of our letters", body + " end", " ".join(rng.choice(prose) for _ in range(300)) + " " + items[i % len(items)]]
    more += [None, "", "  \n"]
    extra = [(top + 1 + i, t, "en", f"site{i % 12}", None if t is None else len(t)) for i, t in enumerate(more)]
    docs = materialize(docs.unionByName(spark.createDataFrame(extra, schema)), "docs")

    before = docs
    kept = materialize(stages["toxicity"](spark, before, SF), "a")
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(before, model).collect() if not r.predicted}
    assert kept.columns == docs.columns and 0 < len(clean) < before.count()
    assert key(map(tuple, kept.collect())) == key(tuple(r) for r in before.collect() if r.doc_id in clean)

    before, kept = kept, materialize(stages["line dedup"](spark, kept, SF), "b")
    rows = before.collect()
    assert kept.columns == docs.columns
    assert key((r.doc_id, r.text) for r in kept.collect()) == key(plain_lines(rows)) != key((r.doc_id, r.text) for r in rows)

    before, kept = kept, materialize(stages["n-gram Jaccard join"](spark, kept, SF), "c")
    rows = [(r.doc_id, r.text) for r in before.collect()]
    first = {d for d, _, c in components(rows) if d == c}
    assert kept.columns == docs.columns and len(first) < len(rows)
    assert key((r.doc_id, r.text) for r in kept.collect()) == key(r for r in rows if r[0] in first)

    before, kept = kept, materialize(stages["benchmark decontamination"](spark, kept, SF), "d")
    rows = [(r.doc_id, r.text) for r in before.collect()]
    gone = {r[0] for r in held_items(rows, list(enumerate(items)))}
    assert kept.columns == docs.columns and gone
    assert key((r.doc_id, r.text) for r in kept.collect()) == key(r for r in rows if r[0] not in gone)

    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    packed = stages["best-fit packing"](spark, kept, SF).toPandas().sort_values(["doc_id", "piece"])
    encoder, ids = Tokenizer.from_file(word_bpe()), {}
    for r in packed.itertuples():
        assert len(r.ids) == 4 * r.length <= 4 * 4096 and r.start == len(ids.get(r.doc_id, []))
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u4").tolist())
    assert ids == {d: [*encoder.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 4096


def test_empty_documents(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, folder, name: spark.read.parquet(f"{folder}/{name}.parquet").limit(0))
    assert corpus_pipeline.run(spark, SF).count() == 0
