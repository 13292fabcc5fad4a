"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1, at most POSITIVES of them, chosen by a hash of
the id.  The unlabelled set is all documents, whatever their label: each goes to the nearest of
CELLS documents in feature space, and a cell stands for its rows by their number and mean.  The
class prior of the unlabelled set is estimated from the score distributions of earlier fits: the
smallest ratio of unlabelled to positive mass above a threshold, chosen with a confidence margin.
A small network then minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss, so its output is the probability of a good text.  Features cover whole texts.

Defined results: null and empty texts are scored as texts of length 0; very long texts are scored
whole in one task; repeated doc_ids are scored row by row, and of repeated labels each distinct
doc_id counts once; ties in the choice of rows go to the smallest doc_id; without positives every
score is 1 (nothing is rejected); an empty table gives no rows; further columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch_spark.llm.common import Scratch, fold_ascii, raw_bytes, remainder, table, windows, word_hashes

NAME = "op2_quality"
ORACLE_SQL = None
POSITIVES = 4000
CELLS = 2000
THRESHOLD = 0.3
HIDDEN = 24
STEPS = 400


def compressed(data: np.ndarray, piece: int = 1 << 16) -> float:
    """The compressed size of all bytes over their number; a piece is held at a time."""
    packer = zlib.compressobj(1)
    size = sum(len(packer.compress(data[k : k + piece].tobytes())) for k in range(0, len(data), piece))
    return (size + len(packer.flush())) / max(1, len(data))


def features(text: str | None) -> list[float]:
    """Of a whole text: character classes, words, repetition, lines."""
    data = raw_bytes(text)
    n = max(1, len(data))
    hashes, starts, ends = word_hashes(fold_ascii(data))
    m = len(hashes)
    if not m:
        return [0.0] * 22
    sizes = ends - starts
    kinds = np.bincount(data, minlength=256)
    letters, upper, digits = kinds[97:123].sum(), kinds[65:91].sum(), kinds[48:58].sum()
    high, space = kinds[128:].sum(), kinds[32] + kinds[9:14].sum()
    stops = kinds[[44, 46, 58, 59]].sum()
    signs = n - letters - upper - digits - high - space - stops
    unique, counts = np.unique(hashes, return_counts=True)
    pairs = windows(hashes, 2)
    triples = windows(hashes, 5)
    last = data[ends - 1]
    odd = ~(((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57)) | (last >= 128) | (last == 44) | (last == 46))
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    alone = (sizes == 1) & odd
    return [
        np.log1p(m),
        np.log1p(n),
        (letters + high) / n,
        upper / n,
        digits / n,
        signs / n,
        kinds[33] / n,
        kinds[124] / n,
        stops / m,
        sizes.mean() / 10,
        sizes.std() / 10,
        len(unique) / m,
        np.log(len(unique) / m + 1e-3),
        counts.max() / m,
        float((hashes[1:] == hashes[:-1]).mean()) if m > 1 else 0.0,
        len(np.unique(pairs)) / len(pairs) if len(pairs) else 1.0,
        len(np.unique(triples)) / len(triples) if len(triples) else 1.0,
        float(odd.mean()),
        float(alone.mean()),
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)),
        compressed(data),
    ]


def measured(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep and x, the features of text."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            got = [[float(v) for v in features(t)] for t in batch.column("_measured").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.select(*keep, F.col("text").cast("string").alias("_measured")).mapInArrow(run, schema)


class Network:
    """One hidden layer; trained by full-batch Adam on the non-negative risk."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        d = len(center)
        self.center, self.scale = center, scale
        self.p = [r.normal(0, (1 / d) ** 0.5, (d, hidden)), np.zeros(hidden), r.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.p
        return np.tanh(self.inputs(x) @ w + b) @ v + c[0]

    def train(self, positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.01, decay: float = 2e-2) -> None:
        """weights: the shares of the unlabelled rows, 1 in all."""
        zp, zu = self.inputs(positive), self.inputs(unlabelled)
        first, second = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        for t in range(1, steps + 1):
            w, b, v, c = self.p
            hp, hu = np.tanh(zp @ w + b), np.tanh(zu @ w + b)
            sp, su = hp @ v + c[0], hu @ v + c[0]
            negative = weights @ np.logaddexp(0, su) - prior * np.logaddexp(0, sp).mean()
            if negative >= 0:  # d/ds of prior*l(s,+) - prior*l(s,-) is -prior
                gp, gu = np.full(len(sp), -prior / len(sp)), sigmoid(su) * weights
            else:  # undo the step that made the negative part overfit
                gp, gu = prior * sigmoid(sp) / len(sp), -sigmoid(su) * weights
            dp, du = np.outer(gp, v) * (1 - hp**2), np.outer(gu, v) * (1 - hu**2)
            grads = [zp.T @ dp + zu.T @ du + decay * w, dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu + decay * v, np.array([gp.sum() + gu.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, rows: int) -> float:
    """The share of positives among the unlabelled (rows of them), from the scores of both.

    For each threshold the unlabelled mass at or above it is at least prior times the positive
    mass there, so each ratio bounds the prior from above; the smallest with its margin is taken.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.5, 101))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([weights @ (unlabelled >= c) for c in cuts])
    margin = np.sqrt(np.log(20) / 2 / len(positive)) + np.sqrt(np.log(20) / 2 / rows)
    best = np.argmin((u + margin) / p)  # the margin keeps the choice away from thin tails
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def cells(rows: DataFrame, order, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, numbers of rows) of all rows (doc_id, x), each with the nearest of many of them; by scaled features."""
    chosen = rows.where(F.col("doc_id").isNotNull()).orderBy(order, "doc_id").limit(many).select("x").toArrow()  # bounded
    if not chosen.num_rows:
        return np.empty((0, 0)), np.empty(0)
    middle = np.stack([np.asarray(x) for x in chosen.column("x").to_pylist()])
    scale = middle.std(axis=0) + 1e-3
    scaled = middle / scale
    squares = (scaled**2).sum(1)

    def run(batches):
        sums, n = np.zeros_like(middle), np.zeros(len(middle), np.int64)
        for batch in batches:
            x = batch.column("x").values.to_numpy().reshape(-1, middle.shape[1])
            for k in range(0, len(x), 512):
                part = x[k : k + 512]
                near = (squares - 2 * (part / scale) @ scaled.T).argmin(1)
                np.add.at(sums, near, part)
                np.add.at(n, near, 1)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen]), pa.array([*sums[seen]], pa.list_(pa.float64()))], names=["cell", "n", "x"])

    totals = rows.select("x").mapInArrow(run, "cell long, n long, x array<double>")
    width = middle.shape[1]
    got = totals.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(width))).collect()  # a row a cell
    n = np.array([r["n"] for r in got], float)
    return np.array([[r[f"x{k}"] for k in range(width)] for r in got]) / n[:, None], n


def weighted_median(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    order = np.argsort(x, axis=0)
    below = np.cumsum(weights[order], axis=0) >= weights.sum() / 2
    return np.take_along_axis(np.take_along_axis(x, order, 0), below.argmax(0)[None], 0)[0]


def fit(measured_rows: DataFrame, labels: DataFrame, keep, positives: int = POSITIVES, many: int = CELLS) -> Network | None:
    """measured_rows: doc_id and x of all documents; keep: the condition on doc_id for rows whose labels may be looked at."""
    order = F.xxhash64(F.lit(7), "doc_id")
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).where(keep).select("doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    p = measured_rows.join(F.broadcast(good), "doc_id").orderBy(order, "doc_id").limit(positives).select("x").toArrow()  # bounded
    xu, n = cells(measured_rows, order, many)
    if p.num_rows < 10 or n.sum() < 10:
        return None
    xp = np.array(p.column("x").to_pylist(), float)
    weights = n / n.sum()
    center = weighted_median(xu, weights)
    scale = np.sqrt(weights @ (xu - weights @ xu) ** 2) + 1e-3
    prior = 0.5
    for _ in range(3):  # each estimate needs scores, and better scores sharpen the estimate
        rough = Network(center, scale)
        rough.train(xp, xu, weights, prior)
        prior = estimate_prior(rough.logits(xp), rough.logits(xu), weights, int(n.sum()))
    out = Network(center, scale)
    out.train(xp, xu, weights, prior)
    out.prior = prior
    return out


def feature_table(docs: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """doc_id, the columns in keep and x of every row, written once: to learn from and to score."""
    return scratch.write(measured(docs, "doc_id", *keep), "features")


def scored(measured_rows: DataFrame, network: Network | None, *keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep (doc_id alone if there are none), score and predicted, from features."""
    keep = keep or ("doc_id",)

    def run(batches):
        for batch in batches:
            x = batch.column("x").values.to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
            out = np.ones(len(x)) if network is None or not len(x) else network.probability(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    schema = T.StructType([*(measured_rows.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return measured_rows.select(*keep, "x").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, keep, positives: int = POSITIVES, many: int = CELLS) -> Network | None:
    """For a network alone; to score the same rows too, write a feature_table and fit and score that."""
    return fit(feature_table(docs, Scratch(docs.sparkSession, "quality")), labels, keep, positives, many)


def score(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted, of rows that a network has not seen."""
    return scored(measured(docs, "doc_id"), network, threshold=threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features_ = feature_table(table(spark, sf_dir, "documents"), Scratch(spark, "quality"))
    network = fit(features_, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return scored(features_, network).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
