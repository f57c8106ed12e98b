"""Document quality by hierarchical empirical Bayes.

A logistic classifier on a few surface features gives each document its own evidence.
Sites add theirs in two levels, host and path within the host: the mean probability of the
site's documents, shrunk towards the level above by as many pseudo-documents as the spread
between sites warrants (method of moments). A host with few documents stays near the
global prior, a path with few near its host. The posterior odds of a document are its own
odds times the odds of its site over the global odds, at the power ``site_power``.

Site sums are grouped aggregates; the join back is by site, whose hot members are spread over
``salts`` tasks. The classifier is fitted on at most ``max_labelled`` labelled rows, the lowest
by a hash of the id (a documented bound of the fit; all documents are scored and counted).

Cases: null and empty texts have all features 0 and score by the fitted intercept and site; a
null host or path is a site of its own; without labelled rows of both kinds the evidence is
neutral (0.5); rows without an id are scored but never labelled; repeated rows are scored each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsky.llm.base import fresh

MAX_LABELLED = 20_000
SITE_POWER = 0.5
SALTS = 16
FEATURES = [
    "log_words", "word_length", "short_words", "distinct_words", "repeats_next", "capitals",
    "symbols", "bars", "exclamations", "digits", "common_words", "line_repeats", "ends_sentence",
]

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()!?|-]")


def features(text: str | None) -> list[float]:
    """Surface features of the whole text, in the order of FEATURES."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    counts = text.count
    return [
        float(np.log1p(n)),
        float(lengths.mean()) / 10,
        float((lengths <= 3).mean()),
        distinct / n**0.8,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        min(1.0, 10 * len(_SYMBOL.findall(text)) / size),
        min(1.0, 10 * counts("|") / size),
        min(1.0, 10 * counts("!") / size),
        min(1.0, 10 * sum(counts(d) for d in "0123456789") / size),
        float((lengths <= 4).sum() - (lengths <= 1).sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(w[-1] in ".!?" for w in words) / n,
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # intercept first


def _expanded(x: np.ndarray) -> np.ndarray:
    """Features with their squares: quality is best at middling values."""
    return np.column_stack([x, x * x])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Classifier:
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("sampled_id"))
        .agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("sampled_id"), "sampled_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("sampled_id"))  # max_labelled rows at most
    rows = sample.select(_features_udf()("text").alias("x"), F.col("label")).toPandas()
    y = (rows["label"] > 0).to_numpy(float)
    width = 2 * len(FEATURES)
    if not len(rows) or not 0 < y.mean() < 1:
        return Classifier(np.zeros(width), np.ones(width), np.zeros(width + 1))
    x = _expanded(np.array(rows["x"].tolist()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    pull = np.full(z.shape[1], 1.0)
    pull[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w)


def _features_udf():
    @F.pandas_udf("array<double>")
    def featured(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return featured


def evidence(docs: DataFrame, classifier: Classifier, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the classifier's probability of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        c = shipped.value
        x = _expanded(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
        z = c.weights[0] + ((x - c.mean) / c.scale) @ c.weights[1:]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -15, 15))))

    return docs.select(
        F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path"), probability(text_col).alias("own")
    )


def shrunk(sites: DataFrame, prior: Column, keys: list[str]) -> DataFrame:
    """keys and posterior of each site: its sum of probabilities and ``strength`` pseudo-documents at the prior.

    The strength is the ratio of the variance inside sites to that between them.
    """
    mean = F.col("total") / F.col("n")
    inside = F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(1e-6))
    spread = sites.select("n", (mean - prior).alias("off"), inside.alias("inside")).agg(
        (F.sum(F.col("n") * F.col("inside")) / F.sum("n")).alias("within"),
        (F.sum(F.col("n") * F.col("off") ** 2) / F.sum("n")).alias("across"),
        (F.count("*") / F.sum("n")).alias("noise"),
    )
    row = spread.first()  # one row
    within = row.within or 1e-6
    between = max((row.across or 0.0) - within * (row.noise or 0.0), 1e-6)
    strength = within / between
    return sites.select(*keys, ((F.col("total") + strength * prior) / (F.col("n") + strength)).alias("posterior"))


def score(
    docs: DataFrame,
    classifier: Classifier,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_power: float = SITE_POWER,
    salts: int = SALTS,
) -> DataFrame:
    """doc_id, host, path, own (classifier), site (posterior of the path), score and kept of each row."""
    from clearsky.session import stored

    # A null site is a site: its name must not meet another one.
    named = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for c in (host, path)]
    rows = stored(evidence(docs, classifier, id_col, text_col, *named), "evidence")
    sums = [F.count("*").alias("n"), F.sum("own").alias("total"), F.sum(F.col("own") ** 2).alias("squares")]
    paths = stored(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    whole = paths.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    base = whole.total / whole.n if whole.n else 0.5
    host_post = shrunk(hosts, F.lit(base), ["host"]).withColumnRenamed("posterior", "above")
    path_post = shrunk(paths.join(host_post, "host"), F.col("above"), ["host", "path"])
    spread = path_post.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def logit(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    together = logit(F.col("own")) + site_power * (logit(F.col("posterior")) - logit(F.lit(base)))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "own"), F.lit(salts)).cast("int"))
        .join(spread, ["host", "path", "salt"])
        .withColumn("score", 1 / (1 + F.exp(-together)))
        .select(
            "doc_id",
            F.when(F.col("host") != "null", F.expr("substring(host, 2)")).alias("host"),
            F.when(F.col("path") != "null", F.expr("substring(path, 2)")).alias("path"),
            "own",
            F.col("posterior").alias("site"),
            "score",
            (F.col("score") >= 0.5).alias("kept"),
        )
    )


def good(docs: DataFrame, classifier: Classifier, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns; rows without an id stay."""
    (gone,) = fresh(docs, "gone_id")
    lost = score(docs, classifier, host, path, id_col, text_col).where("not kept and doc_id is not null")
    return docs.join(lost.select(F.col("doc_id").alias(gone)).distinct(), docs[id_col] == F.col(gone), "left_anti")
