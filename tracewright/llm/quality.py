"""Quality by hierarchical empirical Bayes: document evidence, then host and path, shrunk to the whole.

A logistic regression gives each document's probability of good quality, from surface features and
from the log odds of its words, which are learned in hashed buckets on the other half of the sample.
Hosts and paths have Beta posteriors whose prior strengths are estimated by moments from the grouped
sums of these probabilities: a sparse path leans on its host, a sparse host on the whole. A document's
own share is taken out of its groups before they speak for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_importable, having, lookup_join
from .common import table as read_table
from .fitting import bounded_sample, fit_logistic, held_out, sigmoid
from .shingles import shingle_sets

#: The model is fitted on at most so many labelled documents.
FIT_ROWS, ACCEPT = 20_000, 0.5
#: Words fall into 2^BUCKET_BITS buckets, each with so many documents of either kind beforehand.
BUCKET_BITS, BEFOREHAND = 14, 8.0
FEATURES = ("marks", "bars", "shouts", "capitals", "digits", "distinct_words", "distinct_lines", "repeats", "log_words", "word_length", "empty", "words")
_MARKS = re.compile(r"[#$%&*]")


def features(text: str) -> list[float]:
    words, lines = text.split(), text.split("\n")
    n, count = max(1, len(text)), max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capitals = n - len(text.translate(_NO_CAPITALS)) if text.isascii() else sum(c.isupper() for c in text)
    shares = [len(_MARKS.findall(text)) / n, text.count("|") / count, text.count("!!") / count, capitals / n, len(_DIGITS.findall(text)) / n]
    return [*(min(1.0, 5 * x) for x in shares), len(set(words)) / count, len(set(lines)) / len(lines), repeats / count, float(np.log1p(len(words))), len(text) / count / 10, float(not words)]


_NO_CAPITALS = dict.fromkeys(range(65, 91))
_DIGITS = re.compile(r"\d")


def buckets(texts: list[str | None]) -> list[np.ndarray]:
    """The buckets of each text's distinct words, A-Z in lower case."""
    return [np.unique(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for x in shingle_sets([(t or "").encode() for t in texts], 1)]


def bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many good and other texts each bucket occurs."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for own, good in zip(buckets(batch.column("text").to_pylist()), batch.column("good").to_pylist(), strict=True):
            counts[int(good), own] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << BUCKET_BITS)), pa.array(counts[1]), pa.array(counts[0])], names=["bucket", "good", "other"])


def word_odds(sample: DataFrame) -> np.ndarray:
    """Log odds of each bucket from labelled texts (text, good). The driver gets 2^BUCKET_BITS rows, whatever the input."""
    rows = sample.select("text", "good").mapInArrow(bucket_batches, "bucket long, good long, other long")
    found = rows.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("other").alias("other")).orderBy("bucket").collect()
    counts = np.array([(r["good"], r["other"]) for r in found], float).reshape(-1, 2)
    share = sample.agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("o")).first()
    odds = np.zeros(1 << BUCKET_BITS)
    if len(counts):
        odds[:] = np.log((counts[:, 0] + BEFOREHAND) / (share["g"] + 2 * BEFOREHAND)) - np.log((counts[:, 1] + BEFOREHAND) / (share["o"] + 2 * BEFOREHAND))
    return odds


def inputs(texts: list[str | None], odds: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    words = [[float(odds[own].mean()) if len(own) else 0.0] for own in buckets(texts)]
    return np.array([[*features(t or ""), *w] for t, w in zip(texts, words, strict=True)], float).reshape(len(texts), len(FEATURES))


def input_batches(batches: Iterator[pa.RecordBatch], odds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = inputs(batch.column("text").to_pylist(), odds)
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(list(made), pa.list_(pa.float64()))], names=["good", "x"])


@dataclass
class Evidence:
    """The probability that a text alone speaks for."""

    odds: np.ndarray
    weights: np.ndarray | None = None  # of FEATURES, then the intercept

    def of(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        return sigmoid(np.clip(inputs(texts, self.odds) @ self.weights[:-1] + self.weights[-1], -30, 30))


def learn_evidence(docs: DataFrame, labels: DataFrame, owner: str, fit_rows: int = FIT_ROWS) -> Evidence:
    """From at most fit_rows labelled ids outside of the held-out third. Of an id's labels the least counts, of
    its rows the one of the least hash, so the same tables give the same model."""
    known = labels.select("doc_id", "quality").na.drop().filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(bounded_sample(known, "doc_id", fit_rows))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))
    rows = Scratch.write(rows.select("doc_id", "text", (F.col("quality") == 1).alias("good")), owner, "labelled")
    for_words = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("string")), F.lit(2)) == 0
    odds = word_odds(rows.filter(for_words))
    fit = rows.filter(~for_words).mapInArrow(lambda it: input_batches(it, odds), "good boolean, x array<double>").toPandas()
    if fit["good"].nunique() < 2:
        return Evidence(odds)
    w, mean, scale = fit_logistic(np.stack(fit["x"].to_numpy()), fit["good"].to_numpy(float))
    raw = w[:-1] / scale
    return Evidence(odds, np.append(raw, w[-1] - float((raw * mean).sum())))


def evidence_batches(batches: Iterator[pa.RecordBatch], learned: Evidence) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array(learned.of(batch.column("text").to_pylist()), pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "h", "hp")), made], names=["doc_id", "key", "h", "hp", "evidence"])


def page_site(url: Column) -> tuple[Column, Column]:
    """Host and first part of the path of a URL, for quality_scores()."""
    return F.lower(F.call_function("try_parse_url", url, F.lit("HOST"))), F.substring_index(F.call_function("try_parse_url", url, F.lit("PATH")), "/", 2)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: float) -> float:
    """Prior strength of a level, by moments: how much more the group means differ than their sizes explain."""
    row = groups.filter("n > 1").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("total") / F.col("n") - mean) ** 2).alias("spread"), F.sum("within").alias("within")).first()
    if not row["k"] or row["k"] < 2:
        return 1e6
    sampling = row["within"] / row["n"]
    between = max(0.0, (row["spread"] - row["k"] * sampling) / row["n"])
    return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 1e-12 else 1e6


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    owner: str = "quality",
    fit_rows: int = FIT_ROWS,
    site: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, key, evidence, site, score, held_out, accepted.

    key: 128 bits that tell rows of different ids, texts or sites apart. evidence: the document alone;
    site: its path's and host's posterior without it; score: both combined. ``site`` names host and
    path (default: columns source and lang; see page_site() for URLs). Null texts are empty, which is
    a feature; null hosts and paths are groups of their own. Labels of unknown documents and null
    labels are ignored; without labels of both kinds all evidence is 0.5.
    """
    ensure_importable(docs.sparkSession)
    host, path = site or (F.col("source"), F.col("lang"))
    learned = learn_evidence(docs, labels, owner, fit_rows)
    place = F.struct(host.alias("host"), path.alias("path"))
    slim = docs.select("doc_id", row_key(host, path).alias("key"), F.struct(host.alias("host")).alias("h"), place.alias("hp"), "text")
    table = Scratch.write(slim.mapInArrow(lambda it: evidence_batches(it, learned), slim.drop("text").schema.add("evidence", "double")), owner, "evidence")
    sums = (F.sum("evidence").alias("total"), F.count("*").alias("n"), F.sum(F.col("evidence") * (1 - F.col("evidence"))).alias("within"))
    paths = Scratch.write(table.groupBy("hp").agg(*sums), owner, "paths")
    hosts = paths.groupBy(F.struct("hp.host").alias("h")).agg(*(F.sum(c).alias(c) for c in ("total", "n", "within")))
    hosts = Scratch.write(hosts, owner, "hosts")
    whole = hosts.agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (whole["t"] or 0.0) / max(1, whole["n"] or 0)))
    by_host, by_path = strength(hosts, mean), strength(paths, mean)
    sites = paths.select("hp", F.struct("hp.host").alias("h"), F.col("total").alias("p_total"), F.col("n").alias("p_n")).join(hosts.select("h", F.col("total").alias("h_total"), F.col("n").alias("h_n")), "h").drop("h")
    sites = Scratch.write(sites, owner, "sites")
    read = lookup_join(table, sites, ["hp"])
    own = F.col("evidence")
    host = (by_host * mean + F.col("h_total") - own) / (by_host + F.col("h_n") - 1)
    site = (by_path * host + F.col("p_total") - own) / (by_path + F.col("p_n") - 1)
    read = read.withColumn("site", F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6)))
    score = 1 / (1 + F.exp(-(logit(own) + logit(F.col("site")) - float(np.log(mean / (1 - mean))))))
    return read.select("doc_id", "key", F.round("evidence", 9).alias("evidence"), F.round("site", 9).alias("site"), F.round(score, 9).alias("score"), held_out("doc_id").alias("held_out")).withColumn("accepted", F.col("score") >= ACCEPT)


def row_key(host: Column, path: Column) -> Column:
    parts = ("doc_id", "text", host, path)
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts[::-1]).alias("b"))


def keep_good(docs: DataFrame, labels: DataFrame, owner: str = "quality") -> DataFrame:
    """docs without those rows that are rejected, same columns. Decided by row: other rows of an id, and rows of
    a null one, are judged on their own text and site."""
    scored = quality_scores(docs, labels, owner)
    bad = Scratch.write(scored.filter(~F.col("accepted")).select(F.col("key").alias("_key")).distinct(), owner, "rejected")
    kept = having(docs.select(row_key(F.col("source"), F.col("lang")).alias("_key"), "*"), bad, "_key", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_empirical_bayes(spark, sf_dir):
    """Every document's quality, from labels outside of the held-out third."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "op10").drop("key")
