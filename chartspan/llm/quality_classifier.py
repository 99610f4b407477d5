"""Quality by hierarchical empirical Bayes over documents, hosts and paths (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import SPACES, written

#: Labelled documents that the classifier is fitted on, at most, and the probability of good quality that a document needs.
TRAIN_DOCS, LIMIT = 4000, 0.5
#: What a site's difference from the rest counts against a document's own evidence: all of it, as in Bayes' rule.
SITE_WEIGHT = 1.0
#: A prior's strength, in labelled documents, where sites don't differ beyond chance.
MOST_STRENGTH = 1e4
FEATURES = ("words", "word_length", "upper", "symbols", "exclaims", "bars", "distinct", "line_copies", "ends", "digits", "long_words", "repeats")


def features(text: str | None) -> list[float]:
    """Of the whole text; an empty one is all zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ends = sum(map(text.count, (".\n", ". ", "? ", "! "))) + 1
    return [
        float(np.log1p(n)), chars / n / 8, sum(map(str.isupper, words)) / n, sum(map(text.count, "#*$%&<>")) / n, text.count("!") / n, text.count("|") / n,
        min(1.0, len(set(words)) / n * np.log1p(n) / 5), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, 10 * ends / n), sum(map(text.count, "0123456789")) / max(1, chars), sum(len(w) > 25 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


class Classifier:
    """Logistic regression on standardised features and their squares, calibrated to the labels' share."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), x, np.sqrt(np.abs(x))])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, penalty: float = 1.0) -> Classifier:
        """Newton steps with a ridge. Without rows of both labels, the share of good ones for all (a half for none)."""
        wide = cls._wide(x.reshape(-1, len(FEATURES)))
        mean, scale = (wide.mean(axis=0), wide.std(axis=0) + 1e-9) if len(wide) else (np.zeros(wide.shape[1]), np.ones(wide.shape[1]))
        mean[0], scale[0] = 0, 1
        w = np.zeros(wide.shape[1])
        share = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = np.log(share / (1 - share))
        if 0 < y.sum() < len(y):
            z = (wide - mean) / scale
            ridge = penalty * np.eye(len(w))
            ridge[0, 0] = 1e-6
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
                w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        return cls(mean, scale, w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self._wide(x.reshape(-1, len(FEATURES))) - self.mean) / self.scale @ self.weights, -12, 12)


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """(_id, _y) of labelled documents, a row each; an id labelled both ways is bad."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y"))
    return known.where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> Classifier:
    """Fits on the first `most` labelled documents by hash of id, rows that share an id by the hash of their texts: the same fit
    whatever the order of rows. Only their features leave the executors."""
    rank = F.xxhash64("_id", F.lit(5))
    few = _labels(labels, id_col).orderBy(rank, "_id").limit(most)  # at most `most` rows of two numbers: broadcast
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id").select(rank.alias("a"), F.xxhash64("_text").alias("b"), "_y", "_text")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "y": pdf["_y"], "x": [features(t) for t in pdf["_text"]]})

    got = chosen.mapInPandas(rows, "a long, b long, y int, x array<double>").orderBy("a", "b", "y").limit(most).collect()
    return Classifier.fit(np.array([r["x"] for r in got], np.float64), np.array([r["y"] for r in got], np.float64))


def with_evidence(docs: DataFrame, model: Classifier, text_col: str = "text", to: str = "evidence") -> DataFrame:
    """docs with a column more: the classifier's log odds of good quality for the whole text."""

    @F.pandas_udf("double")
    def odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.log_odds(np.array([features(t) for t in s], np.float64)), dtype="float64")

    return docs.withColumn(to, odds(F.col(text_col)))


def site_counts(labelled: DataFrame) -> DataFrame:
    """(host, path, n, good, hn, hgood): labelled documents and good ones of each site and of its host, from rows of (host, path, y)."""
    paths = written(labelled.groupBy("host", "path").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    return written(paths.join(written(hosts, "hosts"), "host"), "sites")


def strength(groups: DataFrame, n: str, good: str, mean: Column) -> float:
    """Of a beta prior around `mean`, in labelled documents, by the method of moments: groups of n rows with mean m have an expected
    n (rate - m)^2 of m (1 - m) (1 + (n - 1) / (strength + 1)), so the spread beyond chance gives the strength."""
    n_, off = F.col(n), (F.col(good) - F.col(n) * mean) ** 2 / F.col(n)
    row = groups.where(n_ > 0).agg(F.sum(off / (mean * (1 - mean))).alias("spread"), F.sum(n_ - 1).alias("free"), F.count(F.lit(1)).alias("groups")).first()  # one row
    if not row["free"] or row["spread"] <= row["groups"]:
        return MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(0.5, row["free"] / (row["spread"] - row["groups"]) - 1)))


def priors(sites: DataFrame) -> tuple[float, float, float]:
    """(rate over all labelled documents, strength of the hosts' prior around it, strength of the paths' prior around their hosts)."""
    hosts = sites.groupBy("host").agg(F.first("hn").alias("hn"), F.first("hgood").alias("hgood"))
    all_ = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good")).first()  # one row
    rate = ((all_["good"] or 0) + 1) / ((all_["n"] or 0) + 2)
    k_host = strength(hosts, "hn", "hgood", F.lit(rate))
    host_rate = (F.col("hgood") + k_host * rate) / (F.col("hn") + k_host)
    return rate, k_host, strength(sites, "n", "good", host_rate)


def posteriors(rate: float, k_host: float, k_path: float, own: Column, own_good: Column) -> tuple[Column, Column]:
    """(host's, path's) rate of good documents as the others show it, own labels taken out: beta posterior means. So a site of few labelled
    documents has nearly the rate of the level above, and one of many its own."""
    host = (F.col("hgood") - own_good + k_host * rate) / (F.col("hn") - own + k_host)
    return host, (F.col("good") - own_good + k_path * host) / (F.col("n") - own + k_path)


def judge(
    docs: DataFrame, model: Classifier, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", limit: float = LIMIT, weight: float = SITE_WEIGHT
) -> DataFrame:
    """One row per document: id, host, path, n_site, evidence (the classifier's), host_rate, path_rate, probability, kept.

    A site's rate comes from the labels of all its documents but the one judged, shrunk to its host's and that to the rate over all;
    the classifier's evidence comes from the text. The two are added as log odds: the evidence plus `weight` times how far the
    path's posterior lies from the rate over all, so nothing counts twice. n_site counts the site's labelled documents.
    Null hosts and paths are sites of their own, named by an empty string. A null text counts as empty: its features are zeros; a very
    long one is read whole. An id labelled both ways is bad; rows that share a labelled id each count. A probability exactly at the
    limit is kept. Null ids and repeated rows stay. Other columns are ignored. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("_text"))
    scored = written(with_evidence(named, model, "_text").drop("_text").join(_labels(labels, id_col), "_id", "left").withColumnRenamed("_y", "y"), "evidence")
    sites = site_counts(scored)
    rate, k_host, k_path = priors(sites)
    odds = lambda p: F.log(p / (1 - p))
    host_rate, path_rate = posteriors(rate, k_host, k_path, F.col("y").isNotNull().cast("long"), F.coalesce("y", F.lit(0)))
    found = scored.join(sites, ["host", "path"]).withColumns({"host_rate": host_rate, "path_rate": path_rate})
    total = F.col("evidence") + weight * (odds(F.col("path_rate")) - odds(F.lit(rate)))
    found = found.withColumn("probability", 1 / (1 + F.exp(-total)))
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("n").alias("n_site"), "evidence", "host_rate", "path_rate", "probability", (F.col("probability") >= limit).alias("kept"))
