import random

import pytest

from panelweave.llm.toxicity import AIMED, DENIED, PLAIN, PRIOR, REPORTED, THREATENED, Grammar, Lexicon, ToxicModel, drop_toxic, fit, score

rng = random.Random(5)
WORDS = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(900)]


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("What a moron.", {PLAIN}),
        ("You are such a moron", {AIMED}),
        ("He is not a moron", {DENIED}),
        ("She said he is a moron", {REPORTED}),
        ("She said so. He is a moron", {AIMED}),
        ("I will kill you", {THREATENED}),
        ("I will kill him", {THREATENED}),
        ("Please kill the process", set()),
        ("A nice day; nothing here", set()),
        ("MORON!!", {PLAIN}),
        ("zorbling things", {PLAIN}),
        ("zorb", set()),
        ("", set()),
    ],
)
def test_clauses(text, kinds):
    found = Grammar(Lexicon(stems={"zorb": 1.0})).features(text)
    assert {k for k, v in enumerate(found) if v} == kinds


def test_harmless_words_are_overruled():
    assert not any(Grammar(Lexicon(words={"trash": 0.0})).features("take out the trash"))


def text(toxic):
    words = [rng.choice(WORDS) for _ in range(rng.randint(10, 60))]
    for _ in range(rng.randint(2, 3) if toxic else 0):
        words.insert(rng.randrange(len(words)), "grixo" + rng.choice(["ka", "lu", "men", "tor"]))
    return " ".join(w + "." * (rng.random() < 0.1) for w in words)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, text(i % 5 == 0), "x") for i in range(900)]
    rows += [(950, "copy word " + rows[1][1] + " grixoka grixolu", "x")] * 20 + [(960, None, "x"), (961, "", "x"), (None, "grixonew grixotor", "x"), (962, "a " * 70_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, features string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)] + [(950, 1), (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    return docs.cache(), labels.cache()


def test_held_out_accuracy_and_edges(data):
    docs, labels = data
    model = fit(docs, labels)
    assert "grix" in model.lexicon.stems or "grixo" in model.lexicon.stems
    rows = score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == (r.doc_id % 5 == 0) for r in rows if r.held_out and r.doc_id < 900]
    assert sum(held) / len(held) > 0.97
    assert [r.predicted for r in rows if r.doc_id is None] == [1]  # an ending never seen
    left = drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(r.predicted == 0 for r in rows)
    assert score(docs.limit(0), model).collect() == []


def test_without_labels_the_prior_holds(data):
    docs, labels = data
    model = fit(docs, labels.limit(0))
    assert model == ToxicModel(Lexicon(), *PRIOR)
