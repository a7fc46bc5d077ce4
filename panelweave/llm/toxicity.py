"""Toxicity by a weighted grammar of finite-state transducers.

Five transducers read the words of a clause: insults and threats give weight, targets, negations and
reported speech scale it. They are composed into one machine, which scores the clauses that match
and not the words alone. Which words insult, and what matched clauses weigh, is learned from labelled
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.quality import labelled_sample
from panelweave.llm.shared import free_name, held_out, small_batches, text_of
from panelweave.session import materialize

FIT_ROWS = 20_000
THRESHOLD = 0.5
#: A learned word or stem: contexts it stands in among toxic texts, share of toxic ones, standard scores.
MIN_CONTEXTS, MIN_SHARE, MIN_Z = 6, 0.95, 2.8
#: Letters of a stem, and endings it must have been seen with.
STEM_LETTERS, STEM_ENDINGS = (4, 5, 6, 7), 3
MAX_ENTRIES = 5_000
SEED = 17

INSULT, THREAT, TARGET, NEGATION, REPORT, FUTURE, OTHER = "insult threat target negation report future other".split()
#: Words of the grammar that need no labels.
WORDS = {
    INSULT: "idiot idiots moron morons stupid imbecile scum loser losers worthless pathetic disgusting trash clown bastard idiota imbécil estúpido basura dumm dummkopf abschaum idiotin imbécile ordure stupide",
    THREAT: "kill hurt destroy murder beat punish töten umbringen vernichten tuer détruire frapper matar destruir golpear",
    TARGET: "you your you're he she they him her them these those du dich dir ihr euch sie tu toi vous ils elles usted tú ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca ningún jamás",
    REPORT: "said says saying called wrote quoted claimed sagte sagt nannte dit écrit appelé dijo dice llamó",
    FUTURE: "will going shall gonna werde wirst werden vais va vas voy va",
}
#: Words after which a target, negation or future has no more effect.
REACH = {TARGET: 6, NEGATION: 3, FUTURE: 3}
CLAUSE_END = re.compile(r"[.!?;:\n…]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

PLAIN, AIMED, DENIED, REPORTED, THREATENED = range(5)
#: What matched clauses weigh where no labels tell: by kind, then the bias.
PRIOR = ((3.0, 4.0, 1.0, 1.5, 4.0), -4.0)


@dataclass(frozen=True)
class Transducer:
    """States are whole numbers; ``step`` gives the next state and the factor for a core word."""

    start: int
    step: object

    def then(self, other: Transducer) -> Transducer:
        """Both side by side over the same words: pairs of states, factors multiplied."""
        states: dict[tuple[int, int], int] = {(self.start, other.start): 0}
        pairs = [(self.start, other.start)]

        def step(state: int, symbol: str) -> tuple[int, tuple]:
            a, x = self.step(pairs[state][0], symbol)
            b, y = other.step(pairs[state][1], symbol)
            if (a, b) not in states:
                states[(a, b)] = len(pairs)
                pairs.append((a, b))
            return states[(a, b)], x + y

        return Transducer(0, step)


def _within(opener: str, mark: str) -> Transducer:
    """Marks core words up to a reach after an opener; states count down."""
    reach = REACH[opener]

    def step(state: int, symbol: str) -> tuple[int, tuple]:
        if symbol == opener:
            return reach, ()
        return max(0, state - 1), (mark,) if state and symbol in (INSULT, THREAT) else ()

    return Transducer(0, step)


def _reported() -> Transducer:
    """Marks core words after a verb of speech, to the clause's end."""

    def step(state: int, symbol: str) -> tuple[int, tuple]:
        return (1 if symbol == REPORT else state), (REPORT,) if state and symbol in (INSULT, THREAT) else ()

    return Transducer(0, step)


def _core(symbol_: str) -> Transducer:
    def step(state: int, symbol: str) -> tuple[int, tuple]:
        return 0, (symbol_,) if symbol == symbol_ else ()

    return Transducer(0, step)


class Machine:
    """The composed transducers, as a table that fills with the transitions met."""

    def __init__(self) -> None:
        self.whole = _core(INSULT).then(_core(THREAT)).then(_within(TARGET, TARGET)).then(_within(NEGATION, NEGATION)).then(_within(FUTURE, FUTURE)).then(_reported())
        self.table: dict[tuple[int, str], tuple[int, int | None]] = {}

    @staticmethod
    def kind(marks: tuple) -> int | None:
        """What a core word counts as; a threat needs someone it is meant for or a coming time."""
        if REPORT in marks:
            return REPORTED
        if NEGATION in marks:
            return DENIED
        if THREAT in marks:
            return THREATENED if TARGET in marks or FUTURE in marks else None
        if INSULT in marks:
            return AIMED if TARGET in marks else PLAIN
        return None

    def read(self, symbols: list[tuple[str, float]]) -> list[float]:
        """For each kind the weight of a clause's matches."""
        out, state = [0.0] * 5, self.whole.start
        for symbol, weight in symbols:
            move = self.table.get((state, symbol))
            if move is None:
                after, marks = self.whole.step(state, symbol)
                move = self.table[(state, symbol)] = (after, self.kind(marks))
            state, kind = move
            if kind is not None:
                out[kind] += weight
        return out


@dataclass(frozen=True)
class Lexicon:
    """Insults with weights from 0 to 1, whole words and stems; a word known as harmless has weight 0."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def symbols(self) -> dict[str, tuple[str, float]]:
        fixed = {w: (s, 1.0) for s, words in WORDS.items() for w in words.split()}
        return {**fixed, **{w: ((INSULT, v) if v else (OTHER, 0.0)) for w, v in self.words.items()}}


class Grammar:
    """Scores texts inside a task."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.symbols, self.stems = lexicon.symbols(), lexicon.stems
        self.lengths = sorted({len(s) for s in self.stems})
        self.machine = Machine()
        self.cores = ahocorasick.Automaton()
        for core in [*(w for w, (s, v) in self.symbols.items() if s in (INSULT, THREAT) and v), *self.stems]:
            self.cores.add_word(core, 1)
        self.cores.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.symbols.get(word)
        if found is None:
            for n in self.lengths:
                if n < len(word) and (weight := self.stems.get(word[:n])):
                    return INSULT, weight
        return found or (OTHER, 0.0)

    def features(self, text: str) -> list[float]:
        """For each kind of match the sum of its clauses' weights, damped."""
        text = text.lower()
        out = np.zeros(5)
        if next(self.cores.iter(text), None) is None:
            return out.tolist()  # no clause can match
        for clause in CLAUSE_END.split(text):
            if next(self.cores.iter(clause), None) is not None:
                out += self.machine.read([self.symbol(w) for w in WORD.findall(clause)])
        return np.log1p(out).tolist()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that stand in toxic texts and hardly in others.

    ``sample`` has text and label. A word counts once in a text, and
    once for the word before it, so that neither a long text nor copies of one teach more than others. Of a word and its stems the shortest stem that qualifies is kept.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}'’]+"), lambda w: w != "")
    pairs = sample.select("doc_id", "label", words.alias("w")).select(
        "doc_id", "label", F.explode(F.arrays_zip(F.col("w"), F.concat(F.array(F.lit("")), F.col("w")).alias("p"))).alias("x")
    )
    named = pairs.select("doc_id", "label", F.col("x.w").alias("word"), F.xxhash64("x.p").alias("before")).filter("word IS NOT NULL")
    once = named.groupBy("doc_id", "label", "word").agg(F.min("before").alias("before"))
    contexts = once.groupBy("word", "before").agg(F.max("label").alias("toxic"), F.max(1 - F.col("label")).alias("clean"))
    by_word = materialize(contexts.groupBy("word").agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")), "words")
    total = by_word.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0")).first()
    t1, t0 = total["t1"] or 0.0, total["t0"] or 0.0
    if not t1 or not t0:
        return Lexicon()
    odds = F.log((F.col("n1") + 0.5) / (t1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (t0 - F.col("n0") + 0.5))
    z = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    good = (F.col("n1") >= MIN_CONTEXTS) & (share >= MIN_SHARE) & (z >= MIN_Z)
    stems = by_word.select(F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LETTERS])).alias("word"), "n1", "n0")
    stems = stems.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.lit(1)).alias("endings"))
    stems = stems.filter(good & (F.col("endings") >= STEM_ENDINGS))
    best = lambda df: {r["word"]: float(r["share"]) for r in df.select("word", share.alias("share"), z.alias("z")).orderBy(F.desc("z"), "word").limit(MAX_ENTRIES).collect()}
    found, roots = best(by_word.filter(good)), best(stems)
    kept = {s: v for s, v in roots.items() if not any(s[:n] in roots for n in range(1, len(s)))}
    seeds = by_word.filter(F.col("word").isin(WORDS[INSULT].split())).select("word", "n1", "n0", share.alias("share")).collect()
    harmless = {r["word"]: 0.0 for r in seeds if r["n1"] + r["n0"] >= MIN_CONTEXTS and r["share"] < 0.5}
    return Lexicon({**found, **harmless}, kept)


@dataclass(frozen=True)
class ToxicModel:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float


def clause_features(lexicon: Lexicon, text: Column) -> Column:
    """The features of each text, as an array."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield pd.Series([grammar.features(t) for t in batch])

    return features(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> ToxicModel:
    """Lexicon and clause weights from a bounded sample of labelled rows; without both labels the prior."""
    small_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, label, rows, doc_id, text), "sample")
    lexicon = learn_lexicon(sample)
    known = materialize(sample.select("label", clause_features(lexicon, F.col("text")).alias("features")), "features").withColumn("x", array_to_vector("features"))
    if known.select("label").distinct().count() < 2:
        return ToxicModel(lexicon, *PRIOR)
    bound = {"lowerBoundsOnCoefficients": _row(0.0), "upperBoundsOnCoefficients": _row(50.0)}
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-5, standardization=False, maxIter=100, **bound).fit(known.coalesce(4))
    return ToxicModel(lexicon, tuple(float(w) for w in model.coefficients.toArray()), float(model.intercept))


def _row(value: float):
    return Matrices.dense(1, 5, [value] * 5)


def _probability(model: ToxicModel, features: Column) -> Column:
    total = F.lit(model.bias)
    for i, w in enumerate(model.weights):
        total = total + w * features[i]
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Whole texts count. A null text is scored as an empty one, which matches no clause. Repeated rows are
    scored each; a null doc_id is never held out; other columns are dropped; an empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), clause_features(model.lexicon, text_of(text)).alias("features"))
    rows = rows.select("doc_id", held_out("doc_id").alias("held_out"), _probability(model, F.col("features")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns of the others stay.

    Only texts pass through Python; what comes back, and is stored, is the id and text hash of the rows that go.
    Whole rows are then read once, beside that short list. Rows with a null id are judged by their text alone;
    rows that repeat go or stay together; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    body = text_of(f"`{text}`")
    out_id, out_body = free_name(docs, "gone_id"), free_name(docs, "gone_body")
    scored = docs.select(F.col(f"`{doc_id}`").alias(out_id), F.xxhash64(body).alias(out_body), clause_features(model.lexicon, body).alias("features"))
    gone = scored.filter(_probability(model, F.col("features")) >= threshold).select(out_id, out_body).distinct()
    gone = materialize(gone, "toxic")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(out_id)) & (F.xxhash64(body) == F.col(out_body))
    return docs.join(gone, same, "left_anti")
