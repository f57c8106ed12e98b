"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause from left to right and are composed
into one (the product of their states):

* *insult* and *threat* accept lexicon words and put out their weight;
* *target* remembers that the clause addresses or names a person;
* *negation* scopes over the next ``NEGATION_SCOPE`` words;
* *reported speech* scopes over the rest of the clause after a verb of saying.

An accepted word puts out its weight on one of eight tracks: insult or threat,
each plain, targeted, negated or reported. A logistic function of the tracks'
sums over the whole text is the score; text outside matched clauses adds nothing.

Learned from labelled rows: the insult lexicon (words and word beginnings with
their log-odds) and the weights of the tracks. Both come from at most
``max_labelled`` labelled rows, the lowest by a hash of the id, and keep at most
``max_stems`` stems: documented bounds of the classifier, not of the scored texts.
The target, negation, speech and threat words are fixed lists.

Cases: null and empty texts get the score of a text without any match; without
labelled rows only threats count; a null label is no label; ties in the lexicon go by
name; repeated rows are scored each; an empty table gives no rows; further columns
are ignored by :func:`score`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
MAX_STEMS = 4_000
NEGATION_SCOPE = 3
THRESHOLD = 0.3

# Function words of the grammar in English, German, French and Spanish.
TARGETS = set("you your yours yourself ye he she they them him her these those people all du dich dir euch ihr sie tu toi vous te tú usted ustedes vosotros ellos".split())
NEGATIONS = set("not no never none neither nor isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun ni nunca jamás tampoco".split())
SPEECH = set("said says say wrote writes claimed called quoted asked replied reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split())
THREATS = set("kill hurt destroy murder attack shoot stab beat punish umbringen töten tuer frapper matar golpear".split())

TRACKS = [f"{kind} {how}" for kind in ("insult", "threat") for how in ("plain", "targeted", "negated", "reported")]
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n|]")
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Grammar:
    words: dict[str, float]
    beginnings: dict[str, float]
    weights: np.ndarray | None = None  # intercept and one weight per track

    def __post_init__(self) -> None:
        self._machine = None

    def __getstate__(self) -> tuple:
        return self.words, self.beginnings, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.words, self.beginnings, self.weights = state
        self._machine = None

    def machine(self):
        """Aho-Corasick over lexicon and threats: the words that can be accepted at all."""
        if self._machine is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for word in [*self.words, *self.beginnings, *THREATS]:
                found.add_word(word, len(word))
            if len(found):
                found.make_automaton()
            self._machine = found
        return self._machine

    def insult(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in PREFIXES:
            if len(word) > n and word[:n] in self.beginnings:
                return self.beginnings[word[:n]]
        return 0.0


def read_clause(words: list[str], grammar: Grammar) -> list[tuple[int, float]]:
    """The composed transducer: (track, weight) of each accepted word.

    The state is (target seen, words left under negation, reported).
    """
    out = []
    targeted, negated, reported = False, 0, False
    for word in words:
        weight = grammar.insult(word)
        kind = 0 if weight > 0 else 4 if word in THREATS else None
        if kind is not None:
            how = 3 if reported else 2 if negated else 1 if targeted else 0
            out.append((kind + how, weight if kind == 0 else 1.0))
        targeted = targeted or word in TARGETS
        negated = NEGATION_SCOPE if word in NEGATIONS else max(0, negated - 1)
        reported = reported or word in SPEECH
    return out


def tracks(text: str | None, grammar: Grammar) -> np.ndarray:
    """Sums of weights per track over the whole text, in the order of TRACKS."""
    sums = np.zeros(len(TRACKS))
    machine = grammar.machine()
    if not text or not len(machine):
        return sums
    low = text.lower()
    done = 0
    for last, width in machine.iter(low):
        at = last - width + 1
        if at < done or (at and low[at - 1].isalpha()):
            continue
        begin = at
        while begin > done and not _CLAUSE_END.match(low, begin - 1):
            begin -= 1
        stop = _CLAUSE_END.search(low, last + 1)
        done = stop.end() if stop else len(low)
        for track, weight in read_clause(_WORD.findall(low, begin, done), grammar):
            sums[track] += weight
    return sums


def features(text: str | None, grammar: Grammar) -> np.ndarray:
    """Log sums: a second insult tells less than the first."""
    return np.log1p(tracks(text, grammar))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """text and label of the ``most`` labelled rows that are lowest by a hash of the id."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("sampled_id"))
        .agg(F.max(label_col).alias("sampled_label"))
        .orderBy(F.xxhash64("sampled_id"), "sampled_id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("sampled_id"))  # ``most`` rows at most
    return found.select("text", F.col("sampled_label").alias("label"))


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, positive and all documents with it, for whole words (``=word``) and beginnings."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = set(_WORD.findall(text.lower()))
                stems = {f"={w}" for w in words} | {w[:n] for n in PREFIXES for w in words if len(w) > n}
                for stem in stems:
                    pair = seen.setdefault(stem, [0, 0])
                    pair[0] += label > 0
                    pair[1] += 1
        if seen:
            rows = np.array(list(seen.values()))
            yield pd.DataFrame({"stem": list(seen), "positive": rows[:, 0], "every": rows[:, 1]})

    partial = sample.mapInPandas(counted, "stem string, positive long, every long")
    return partial.groupBy("stem").agg(F.sum("positive").alias("positive"), F.sum("every").alias("every"))


def lexicon(sample: DataFrame, max_stems: int = MAX_STEMS) -> Grammar:
    """Stems that labelled documents single out: twice the odds at least, and beyond chance."""
    size = sample.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("p")).first()
    n, p = size.n, size.p or 0
    if not p or p == n:
        return Grammar({}, {})
    base = p / n
    odds = F.log((F.col("positive") + 0.5) / (F.col("every") - F.col("positive") + 0.5)) - float(np.log(base / (1 - base)))
    spread = F.sqrt(F.col("every") * base * (1 - base))
    rows = (
        stem_counts(sample)
        .withColumns({"weight": odds, "z": (F.col("positive") - F.col("every") * base) / spread})
        .where((F.col("positive") >= 4) & (F.col("z") >= 6) & (F.col("weight") >= 1.5))
        .orderBy(F.col("z").desc(), "stem")
        .limit(max_stems)
        .collect()
    )
    words = {r.stem[1:]: r.weight for r in rows if r.stem.startswith("=")}
    return Grammar(words, {r.stem: r.weight for r in rows if not r.stem.startswith("=")})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
    max_stems: int = MAX_STEMS,
) -> Grammar:
    """Lexicon and weights; the rows are split by hash, so that weights are learned on texts the lexicon has not seen."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, max_labelled)
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    grammar = lexicon(sample.where(half == 0), max_stems)
    shipped = sample.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("array<double>")
    def featured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t, shipped.value))

    rows = sample.where(half == 1).select(featured("text").alias("x"), "label").toPandas()  # max_labelled rows at most
    if len(rows) and 0 < (rows["label"] > 0).mean() < 1:
        grammar.weights = _logistic(np.array(rows["x"].tolist()), (rows["label"] > 0).to_numpy(float))
    else:
        grammar.weights = np.array([-3.0, *[1.0] * len(TRACKS)])
    full = lexicon(sample, max_stems)
    full.weights = grammar.weights
    return full


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method with a ridge towards 0 (the intercept is free)."""
    x = np.column_stack([np.ones(len(x)), x])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        g = shipped.value
        x = np.array([features(t, g) for t in texts]).reshape(len(texts), len(TRACKS))
        return pd.Series(1 / (1 + np.exp(-np.clip(g.weights[0] + x @ g.weights[1:], -30, 30))))

    return docs.select(F.col(id_col).alias("doc_id"), scored(text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
