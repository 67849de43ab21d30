"""Quality classifier: document evidence joined with host and path posteriors by empirical Bayes.

A document's evidence comes from two logistic models (poor quality, toxic), each on a dozen
character and line statistics and on the words that tell its labels apart best, fitted on at most
TRAIN labelled documents (the smallest hashes of their ids). The hierarchy is global, host, path:
sums of the models' probabilities over all documents, by grouped aggregation, give every host and
path its share of bad documents; how strongly a site is drawn to the level above is its
pseudo-count, estimated from the spread between sites by the method of moments, so sparse sites
sink into the global prior and large ones keep their own. A document is judged by its evidence
as a likelihood ratio times its path's posterior odds, its own share left out.

Documents stay in scan order through the models; only (id, site, two numbers) is grouped. The
site sums are map-side combined, so a host with a third of all rows is a few rows per task.

Defined results: null text counts as empty; a null host or path is a site of its own; repeated
rows are judged each; a doc_id with several labels counts as poor or toxic if one of them says so;
labels tie by the hash of their ids, then by id; without labels of both kinds a model gives no
evidence and the document is kept; a table without source or lang is one site; an empty table gives
an empty result. Texts are read whole whatever their length. Of the columns only doc_id, text, source
and lang are read, so others may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import stored, table

TRAIN = 8_000
WORDS = 192
_TOKEN = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]{2,}")
_DIGITS = re.compile(r"\d+")
DENSE = 11
RARE = -4.0
HEADS = ("low", "toxic")


def statistics(text: str) -> tuple[list[float], set[str]]:
    """Shares of odd characters, words and lines, and the distinct lower-case words."""
    words, lines = _TOKEN.findall(text), text.split("\n")
    n, w, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    lower = [x.lower() for x in words]
    seen = set(lower)
    marks = _MARKS.findall(text)
    return [
        sum(x.isupper() and len(x) > 1 for x in words) / w,
        min(1.0, len(marks) / w),
        min(1.0, text.count("|") / w),
        sum(map(len, _DIGITS.findall(text))) / n,
        1 - len(set(lines)) / k,
        len(seen) / w,
        min(1.0, sum(map(len, words)) / w / 20),
        min(1.0, text.count("!") / w),
        min(1.0, (text.count("*") + text.count("&") + text.count("%") + text.count("#") + text.count("$")) / w),
        np.log1p(len(words)) / 12,
        min(1.0, k / w),
    ], seen


class Model:
    """Two logistic heads over the same columns."""

    def __init__(self, words: dict[str, list[str]], weights: dict[str, tuple[np.ndarray, float] | None]):
        self.words = {h: {w: i for i, w in enumerate(words[h])} for h in HEADS}
        self.weights = weights

    def base(self) -> dict[str, float]:
        """The training rows' prior log odds of each head; a head that saw no labels takes bad documents to be rare."""
        return {h: self.weights[h][1] if self.weights[h] else RARE for h in HEADS}

    def row(self, head: str, dense: list[float], seen: set[str]) -> np.ndarray:
        x = np.zeros(1 + DENSE + len(self.words[head]))
        x[0], x[1 : 1 + DENSE] = 1, dense
        for w in seen & self.words[head].keys():
            x[1 + DENSE + self.words[head][w]] = 1
        return x

    def evidence(self, text: str) -> list[float]:
        """Log likelihood ratios of the heads, without the prior of the training rows."""
        dense, seen = statistics(text)
        out = []
        for h in HEADS:
            fit = self.weights[h]
            out.append(float(np.clip(self.row(h, dense, seen) @ fit[0] - fit[1], -30, 30)) if fit else 0.0)
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN, n_words: int = WORDS) -> Model:
    """docs: doc_id, text. At most `train` labelled rows come to the driver, as statistics and words."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    told = told.groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    picked = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)

    def measure(batches):
        for b in batches:
            got = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("low"), b.column("toxic"), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([sorted(g[1]) for g in got], pa.list_(pa.string()))], names=["doc_id", "low", "toxic", "dense", "words"])

    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "low", "toxic", "text")  # at most `train` rows of three numbers
    rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("low", "toxic", "text"), F.struct(F.length("text"), F.col("text"))).alias("one")).select("doc_id", "one.*")  # one text for each id
    rows = stored(rows.mapInArrow(measure, "doc_id long, low boolean, toxic boolean, dense array<double>, words array<string>"), "quality-sample")
    some = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(h)).alias(h) for h in HEADS]).collect()[0]
    each = rows.select(*HEADS, F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), *[F.count_if(F.col(h)).alias(h) for h in HEADS]).where("df >= 3")
    words: dict[str, list[str]] = {}
    for h in HEADS:
        p = (F.col(h) + 0.5) / (F.col("df") + 1)
        base = (some[h] + 0.5) / (some["n"] + 1)
        gain = F.col("df") * (p * F.log(p / base) + (1 - p) * F.log((1 - p) / (1 - base)))
        words[h] = sorted(r["word"] for r in each.orderBy(F.desc(gain), "word").limit(n_words).collect())
    model = Model(words, dict.fromkeys(HEADS))
    chosen = F.array(*[F.lit(w) for w in sorted({w for h in HEADS for w in words[h]})]).cast("array<string>")
    # only chosen words come to the driver
    sample = rows.withColumn("words", F.array_intersect("words", chosen)).orderBy("doc_id", *HEADS, "dense").toArrow()
    dense, seen = sample.column("dense").to_pylist(), [set(w) for w in sample.column("words").to_pylist()]
    for h in HEADS:
        if some[h] in (0, some["n"]) or not some["n"]:
            continue
        x = np.stack([model.row(h, d, s) for d, s in zip(dense, seen)])
        y = np.array([bool(v) for v in sample.column(h).to_pylist()], float)
        model.weights[h] = (logistic(x, y), float(np.log(y.mean() / (1 - y.mean()))))
    return model


def _strength(sites: DataFrame, n: str, s: str, mean: float) -> float:
    """Pseudo-count of a level: by moments, from the spread of its sites beyond sampling noise."""
    share = F.col(s) / F.col(n)
    r = sites.agg(F.sum(n).alias("n"), F.sum(F.col(n) * (share - mean) * (share - mean)).alias("between"), F.count(F.lit(1)).alias("k")).collect()[0]
    if not r["k"] or r["k"] < 2 or not r["n"]:
        return 1.0
    noise = mean * (1 - mean) * r["k"] / r["n"]
    spread = max(r["between"] / r["n"] - noise, 0.0)
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 1e6)) if spread > 0 else 1e6


def posterior(scores: DataFrame, base: dict[str, float]) -> DataFrame:
    """scores: host, path, low, toxic (log likelihood ratios). Adds p_low and p_toxic."""
    out = scores
    for h in HEADS:
        out = out.withColumn(f"own_{h}", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(h) + F.lit(base[h])))))
    paths = out.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"own_{h}").alias(f"s_{h}") for h in HEADS])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"s_{h}").alias(f"host_{h}") for h in HEADS])
    total = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_{h}").alias(h) for h in HEADS]).collect()[0]
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    strength: dict[str, tuple[float, float, float]] = {}
    for h in HEADS:
        mean = (total[h] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
        strength[h] = (mean, _strength(hosts, "host_n", f"host_{h}", mean), _strength(paths, "n", f"s_{h}", mean))
    sites = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "host_n", *[f"s_{h}" for h in HEADS], *[f"host_{h}" for h in HEADS])
    out = out.join(sites, out["host"].eqNullSafe(sites["site_host"]) & out["path"].eqNullSafe(sites["site_path"])).drop("site_host", "site_path")
    for h in HEADS:
        mean, of_host, of_path = strength[h]
        host = (F.col(f"host_{h}") - F.col(f"own_{h}") + of_host * mean) / (F.col("host_n") - 1 + of_host)
        path = (F.col(f"s_{h}") - F.col(f"own_{h}") + of_path * host) / (F.col("n") - 1 + of_path)
        prior = F.least(F.greatest(path, F.lit(1e-4)), F.lit(1 - 1e-4))
        out = out.withColumn(f"prior_{h}", prior).withColumn(f"p_{h}", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(h) + F.log(prior / (1 - prior))))))
    return out


def classify(docs: DataFrame, labels: DataFrame, host=None, path=None, reject: float = 0.4, train: int = TRAIN) -> DataFrame:
    """doc_id, text_key, host, path, p_low, p_toxic, prior_low, prior_toxic, keep for every row of docs."""
    source, lang = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang"))
    host = source if host is None else host
    path = F.concat_ws("/", source, lang) if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.select("doc_id", "text"), labels, train))

    def score(batches):
        for b in batches:
            got = [model.value.evidence(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "text_key", "host", "path")], *[pa.array([g[i] for g in got], pa.float64()) for i in range(2)]], names=["doc_id", "text_key", "host", "path", *HEADS])

    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "host", "path", "text")
    scores = stored(keyed.mapInArrow(score, "doc_id long, text_key long, host string, path string, low double, toxic double"), "quality-scores")
    return posterior(scores, model.value.base()).select("doc_id", "text_key", "host", "path", "p_low", "p_toxic", "prior_low", "prior_toxic", ((F.col("p_low") < reject) & (F.col("p_toxic") < reject)).alias("keep"))


def op1_hierarchical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    judged = classify(docs, labels).where(~F.col("keep")).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("bad_key"))
    return docs.join(judged.hint("shuffle_hash"), same, "left_anti")
