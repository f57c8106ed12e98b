"""Language identification as mixture inference.

Learning counts the letter trigrams of all labelled texts: each task adds up its
texts per language in ``BUCKETS`` hashed buckets, the sums per (language, bucket)
are the model - at most ``max_languages * BUCKETS`` numbers, whatever the corpus.

Prediction runs expectation-maximisation for each whole text: its trigrams come
from a mixture of languages with unknown proportions. Sets of one, two, ...
languages (by their proportion in the full mixture) are compared by penalised
likelihood; trigrams overlap, so the likelihood counts a third. The largest proportion in
the chosen set is the prediction, its proportion times the posterior of that
language against the others the score.

Cases: a null text or one without any letter is ``und`` with score 0; without
labelled texts everything is ``und``; ties go to the first language by name; a null
``doc_id`` counts as the empty text in the hold-out rule; repeated rows are predicted
each; an empty table gives no rows; further columns are ignored by :func:`predict`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsky.llm.base import slices

BUCKETS = 1 << 15
MAX_LANGUAGES = 256
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams with a letter in the middle; anything but letters counts as a blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17))[letter[1:-1]]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)


def count(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows with a text and a language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("l")["t"]:
                total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                texts = texts.tolist()
                for a, b in slices(texts):
                    total += np.bincount(trigrams("\n".join(texts[a:b])), minlength=BUCKETS)
        for lang, total in sums.items():
            there = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": there.astype(np.int32), "n": total[there]})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    partial = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).mapInPandas(
        counted, "lang string, bucket int, n long"
    )
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """The model of all labelled rows; more than ``max_languages`` languages are an error, not a cut."""
    if docs.select(lang_col).distinct().limit(max_languages + 2).count() > max_languages + 1:
        raise ValueError(f"more than {max_languages} languages")
    rows = count(docs, text_col, lang_col).toPandas()  # BUCKETS rows a language at most
    languages = sorted(rows["lang"].unique())
    n = np.zeros((BUCKETS, len(languages)))
    n[rows["bucket"], np.searchsorted(languages, rows["lang"])] = rows["n"]
    common = (n.sum(axis=1, keepdims=True) + 0.01) / (n.sum() + 0.01 * BUCKETS)
    strength = 2000.0  # pseudo-trigrams from all languages together
    return Model([str(x) for x in languages], np.log((n + strength * common) / (n.sum(axis=0) + strength)))


def _mixture(p: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions by EM, and the log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        moved = share * ((weight / (p @ share)) @ p) / total
        if np.abs(moved - share).max() < 1e-3:
            share = moved
            break
        share = moved
    return share, float(weight @ np.log(p @ share))


def infer(text: str | None, model: Model, rounds: int = 20) -> tuple[str, float, dict[str, float]]:
    """Prediction, score, and the chosen languages with their proportions."""
    grams = trigrams(text) if text and model.languages else ()
    if not len(grams):
        return UNDETERMINED, 0.0, {}
    buckets, weight = np.unique(grams, return_counts=True)
    logs = model.log_p[buckets]
    highest = logs.max(axis=1, keepdims=True)
    p, weight = np.exp(logs - highest), weight.astype(float)
    alone = weight @ (logs - highest) / 3
    order = np.argsort(-alone, kind="stable")[:1]
    best, chosen, shares = float(alone.max()), order, np.ones(1)
    n = weight.sum() / 3
    if len(model.languages) > 1:
        full, fits = _mixture(p, weight, rounds)
        # No mixture fits better than this (the log-likelihood is concave), so larger sets cannot rise above it.
        limit = fits + weight.sum() * np.log(((weight / (p @ full)) @ p).max() / weight.sum())
        ranked = np.argsort(-full, kind="stable")
        best -= np.log(n + 1)
        for k in range(2, len(ranked) + 1):
            if limit / 3 - k * np.log(n + 1) <= best:
                break
            members = ranked[:k]
            share, fits = _mixture(p[:, members], weight, rounds)
            if (value := fits / 3 - k * np.log(n + 1)) > best:
                best, chosen, shares = value, members, share
    first = int(np.argmax(shares))
    posterior = np.exp(alone - alone.max())
    odds = posterior[chosen[first]] / posterior.sum() if len(chosen) == 1 else 1.0
    found = {model.languages[j]: float(s) for j, s in zip(chosen, shares, strict=True)}
    return model.languages[chosen[first]], float(min(1.0, shares[first] * odds)), found


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, mixture (language -> proportion) of each row; ``keep`` names columns to carry."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, mixture map<string, double>")
    def inferred(texts: pd.Series) -> pd.DataFrame:
        rows = [infer(t, shipped.value) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "mixture"])

    return docs.select(F.col(id_col).alias("doc_id"), *keep, inferred(text_col).alias("found")).select(
        "doc_id", *keep, "found.lang_pred", "found.score", "found.mixture"
    )


def determined(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in one of the model's languages."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: infer(t, shipped.value)[0] != UNDETERMINED).astype(bool)

    return docs.where(known(text_col))
