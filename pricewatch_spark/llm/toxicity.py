"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding: NFKC, lower case, homoglyphs of Cyrillic and Greek to Latin, digits and signs that stand
for letters inside words, no zero-width characters; then words of letters, one space between.
Lexicon entries are whole words (" idiot ") or beginnings of words (" mor"), so one automaton
finds both.  Their weights are smoothed log-odds of documents that hold them, toxic against
clean, counted over a bounded sample of labelled rows (LEARN_ROWS a class).  Exception phrases
cancel the entries they cover: those given, and phrases of two or three words around a lexicon word
that the sample's clean rows hold e times as often as its toxic ones, or more.  The score is a logistic function of the matched weight, raw and
by length, fitted on the same sample.

Defined results: null and empty texts have no match and get the score of an unmatched text;
repeated doc_ids and null ones are scored row by row (of a repeated doc_id one row teaches, that of
the smallest hash of its text; a row without doc_id teaches nothing and isn't held out); very long texts are scored whole in one task;
overlapping matches all count but for those an exception phrase covers; without labels of both
classes every score is 0; an empty table gives no rows; further columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, remainder, rows_of, table, texts

NAME = "op5_toxicity"
ORACLE_SQL = None
LEARN_ROWS = 3000
THRESHOLD = 0.7
LONGEST_PREFIX = 7
#: Log-odds, toxic against clean, that a lexicon entry exceeds and that a learned exception stays below.
TOXIC, HARMLESS = 1.5, -1.0
#: Harmless phrases with words that are used as insults, besides those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "rodeo clown", "scum of the pond", "pond scum")
_LOOKS = str.maketrans(
    {
        **dict(zip("абвгдеёзкмнопрстухіјѕԁ", "abbrdee3kmhonpctyxijsd", strict=True)),
        **dict(zip("αβεηικνορτυχ", "abenikvoptux", strict=True)),
        **{c: None for c in "​‌‍⁠﻿­"},
        "р": "p", "с": "c", "т": "t", "в": "b", "н": "h", "г": "r", "з": "e",
    }
)
_DIGITS = str.maketrans("0134578@$", "oieastbas")
_RUN = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*|[@$][^\W_]+")
_SPECIAL = re.compile(r"[0134578@$]")


def fold(text: str) -> str:
    """Folded words with single spaces between and around; '' stays ''."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LOOKS)
    words = _RUN.findall(text)
    if _SPECIAL.search(text):
        words = [w.translate(_DIGITS) if not w.isalpha() and not w.isdigit() else w for w in words]
    return f" {' '.join(words)} " if words else ""


def entries(folded: str) -> set[str]:
    """The candidate lexicon entries of a text."""
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        for n in range(3, min(LONGEST_PREFIX, len(w) - 1) + 1):
            found.add(f" {w[:n]}")
    return found


def phrases(folded: str, lexicon: dict[str, float]) -> set[str]:
    """The phrases of two or three words around each word that the lexicon knows."""
    words, found = folded.split(), set()
    for i, w in enumerate(words):
        if f" {w} " in lexicon or any(f" {w[:n]}" in lexicon for n in range(3, min(LONGEST_PREFIX, len(w) - 1) + 1)):
            for a, b in ((i - 1, i + 1), (i, i + 2), (i - 2, i + 1), (i - 1, i + 2), (i, i + 3)):
                if a >= 0 and b <= len(words):
                    found.add(" ".join(words[a:b]))
    return found


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled rows of each class, chosen by a hash; one row a doc_id."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.where(keep)
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = own.where("label = 1").orderBy(order).limit(rows).unionByName(own.where("label = 0").orderBy(order).limit(rows))
    # at most 2 * rows ids, so they are broadcast; however often an id repeats, one text of it is kept
    held = texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return held.select("doc_id", "t.text", "label")


class Lexicon:
    """Weights by entry, and what turns matches into a score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions, self.beta = weights, exceptions, None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    @staticmethod
    def features(folded: str, automaton) -> tuple[float, float, float, float]:
        """Of the best entry of each word: weight sum, weight by length, largest weight, distinct."""
        if not folded or not len(automaton):
            return (0.0, 0.0, 0.0, 0.0)
        best: dict[int, tuple[float, str]] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                covered.append((start, end))
            elif start not in best or weight > best[start][0]:
                best[start] = (weight, folded[start : end + 1])
        for a, b in covered:
            for k in [k for k in best if a <= k < b]:
                del best[k]
        if not best:
            return (0.0, 0.0, 0.0, 0.0)
        total = sum(w for w, _ in best.values())
        words = folded.count(" ") - 1
        return (math.log1p(total), total / (words + 20), max(w for w, _ in best.values()), math.log1p(len({e for _, e in best.values()})))

    def fit(self, features: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression by Newton's method; each class has half of the weight's prior odds as seen."""
        x = np.hstack([features, np.ones((len(features), 1))])
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6]) * len(x) / 100
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def score(self, features: tuple) -> float:
        if self.beta is None:
            return 0.0
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot([*features, 1.0], self.beta)))))))


def odds(sample: DataFrame, found, n: dict[int, int]) -> DataFrame:
    """entry, t, c and w: of what found(folded text) gives, in how many toxic and clean rows it is, and its log-odds."""

    def counted(batches):
        both = (Counter(), Counter())
        for text, label in rows_of(batches, "text", "label"):
            both[label].update(found(fold(text)))
        for label, counts in enumerate(both):
            yield pa.RecordBatch.from_arrays(
                [pa.array([*counts], pa.string()), pa.array([label] * len(counts), pa.int32()), pa.array([*counts.values()], pa.int64())],
                names=["entry", "label", "n"],
            )

    counts = sample.select("text", "label").mapInArrow(counted, "entry string, label int, n long")
    sums = counts.groupBy("entry").agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("t"), F.sum(F.expr("if(label = 0, n, 0)")).alias("c"))
    return sums.withColumn("w", F.log((F.col("t") + 0.2) / (n[1] + 0.4)) - F.log((F.col("c") + 0.2) / (n[0] + 0.4)))


def learn(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """sample: doc_id, text, label, of a bounded number of rows; it is read several times.

    An entry is in at least 3 toxic rows and a phrase in at least 3 clean ones (one in 400 of a larger sample), so the
    rows that come to the driver are bounded by the sample as well.
    """
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, exceptions)
    chosen = odds(sample, entries, n).where(f"t >= {max(3, n[1] // 400)} and w > {TOXIC}").select("entry", "w").orderBy("entry").collect()
    weights = {r["entry"]: r["w"] for r in chosen}
    harmless = odds(sample, lambda folded: phrases(folded, weights), n).where(f"c >= {max(3, n[0] // 400)} and w < {HARMLESS}")
    learned = tuple(r["entry"] for r in harmless.select("entry").orderBy("entry").collect())
    lexicon = Lexicon(weights, tuple(dict.fromkeys((*exceptions, *learned))))

    def measured(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            got = [Lexicon.features(fold(x or ""), automaton) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(got, pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.select("text", "label").mapInArrow(measured, "label int, x array<double>").collect()  # 4 numbers a row
    # rows of either class count as often as the label does among all labelled rows of the sample
    lexicon.fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, matched (the number of distinct entries found)."""
    kind = dict(docs.dtypes)["doc_id"]

    def scored(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            got = [Lexicon.features(fold(x or ""), automaton) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([lexicon.score(x) for x in got], pa.float64()),
                    pa.array([round(math.expm1(x[3])) for x in got], pa.int32()),
                ],
                names=["doc_id", "score", "matched"],
            )

    return texts(docs).mapInArrow(scored, f"doc_id {kind}, score double, matched int").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = Scratch(spark, "toxicity").write(learning_rows(docs, table(spark, sf_dir, "labels"), "toxic", remainder(3) != 1), "sample")
    return score(docs, learn(sample)).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "matched")
