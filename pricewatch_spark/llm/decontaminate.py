"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as words: lower-case runs of letters and digits.  Of each test item the rare
n-grams are seeds: those that a document of mean length is expected to hold with a chance of at
most RARE, from the frequencies of their words over all documents; an item always keeps its
LEAST_SEEDS rarest, and an item shorter than n words is one seed.  Seeds are a table; a join on
their hashes brings documents and items together.  Tasks hold a bit filter of the seeds, of at
most MOST_BITS bits however many items there are, which only keeps n-grams that no seed has out
of the join.  The stretch of the document around the seeds is aligned locally with the item (match
2, mismatch -1, gap -1), and a pair is reported if the score reaches THRESHOLD of a full match.

Defined results: null and empty texts have no words and match nothing; items without words match
nothing; repeated items are items of their own, and a null item_id is reported as null; every row
of docs is compared, repeated rows and null doc_ids included; very long texts are compared whole
(a text is held in one task); of equally good alignments the first is reported; empty tables give
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, as_long, fold_ascii, mix, raw_bytes, table, windows, word_hashes
from pricewatch_spark.llm.repeats import arrays, hashed

NAME = "op3_decontaminate"
ORACLE_SQL = None
GRAM = 3
RARE = 1e-4
LEAST_SEEDS = 5
THRESHOLD = 0.5
BITS_A_SEED = 128
MOST_BITS = 1 << 28  # 32 MB a worker
FLUSH = 1 << 20
_MATCH, _MISMATCH, _GAP = 2, -1, -1
#: Every ASCII byte that is no letter or digit separates words.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalnum()]] = 32
_MARKS = re.compile(r"[^\w\s]|_")


def words(text: str | None) -> np.ndarray:
    """Hashes of the normalised words."""
    text = text or ""
    if not text.isascii():
        text = _MARKS.sub(" ", unicodedata.normalize("NFKC", text).lower())
    return word_hashes(_BLANK[fold_ascii(raw_bytes(text))])[0]


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(best local score, first and last word of the stretch that the best alignment covers)."""
    n = len(stretch)
    ramp = -_GAP * np.arange(n + 1)
    last = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)  # where the alignment that ends here began
    best, span = 0, (0, 0)
    for w in item:
        diagonal = last[:-1] + np.where(stretch == w, _MATCH, _MISMATCH)
        up = last[1:] + _GAP
        row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal >= up
        better = np.where(take, diagonal, up)
        positive = better > 0
        row[1:][positive] = better[positive]
        start[1:][positive] = np.where(take, begin[:-1], begin[1:])[positive]
        # gaps in the item: a running maximum of what lies to the left, less its distance
        lifted = row + ramp
        peak = np.maximum.accumulate(lifted)
        from_left = peak > lifted
        if from_left.any():
            at = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
            row, start = np.where(from_left, peak - ramp, row), np.where(from_left, start[at], start)
        j = int(row.argmax())
        if row[j] > best:
            best, span = int(row[j]), (int(start[j]), j - 1)
        last, begin = row, start
    return best, span[0], span[1]


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes) of the items that have any."""
    kind = dict(benchmark.dtypes)["item_id"]

    def run(batches):
        for batch in batches:
            found = [words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([as_long(x) for x in found], pa.list_(pa.int64()))], names=["item_id", "words"])

    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, words array<long>").where("size(words) > 0")


def word_counts(docs: DataFrame) -> DataFrame:
    """w, c: over all documents."""

    def run(batches):
        def flush(held):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(found)), pa.array(n.astype(np.int64))], names=["w", "c"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(words(text.as_py()))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def grams(of: np.ndarray, size: int) -> np.ndarray:
    return mix(windows(of, size) + np.uint64(size))


def seeds_of(items: DataFrame, counts: DataFrame, mean: float, total: int) -> DataFrame:
    """hash, key, place, n: the rare n-grams of each item (key, words), and how many words it has."""
    flat = items.select("key", F.posexplode("words").alias("p", "w")).join(counts, "w", "left")
    whole = flat.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "w", F.coalesce("c", F.lit(0)).alias("c")))).alias("x"))  # an item's words

    def run(batches):
        for batch in batches:
            hashes, keys, places, lengths = [], [], [], []
            for key, own, c in zip(batch.column("key").to_pylist(), arrays(batch.column("w")), arrays(batch.column("c")), strict=True):
                size = min(GRAM, len(own))
                found = grams(own.view(np.uint64), size)
                rate = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(c / max(1, total), 1e-12)))])
                chance = np.log(max(mean, 1.0)) + rate[size:] - rate[: len(found)]
                order = np.argsort(chance, kind="stable")
                keep = order[(chance[order] <= np.log(RARE)) | (np.arange(len(order)) < LEAST_SEEDS)]
                hashes.append(as_long(found[keep]))
                keys.append(np.full(len(keep), key))
                places.append(keep.astype(np.int32))
                lengths.append(np.full(len(keep), len(own), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, keys, places, lengths)], names=["hash", "key", "place", "n"])

    return whole.select("key", F.col("x.w").alias("w"), F.col("x.c").alias("c")).mapInArrow(run, "hash long, key long, place int, n int")


class Filter:
    """Which hashes may be seeds: two bits a seed in an array of bounded size."""

    def __init__(self, seeds: DataFrame, n_seeds: int):
        bits = 1 << 16
        while bits < min(MOST_BITS, BITS_A_SEED * n_seeds):
            bits *= 2
        self.mask = np.int64(bits - 1)
        at = F.explode(F.array(F.col("hash").bitwiseAND(int(self.mask)), F.shiftright("hash", 32).bitwiseAND(int(self.mask))))
        set_bits = seeds.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        rows = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
        self.bits = np.zeros(bits >> 6, np.int64)
        self.bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.int64)
        first, second = h & self.mask, (h >> np.int64(32)) & self.mask
        good = (self.bits[first >> 6] >> (first & 63)) & 1
        return (good & (self.bits[second >> 6] >> (second & 63))).astype(bool)


def hits_of(docs: DataFrame, may: Filter, sizes: list[int]) -> DataFrame:
    """doc_id, text_hash, words, hashes, at: of documents that may hold seeds, where."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column("text")):
                own = words(text.as_py())
                hashes, at = [], []
                for size in sizes:
                    found = grams(own, size)
                    good = np.flatnonzero(may.may_hold(found)) if len(found) else np.empty(0, np.int64)
                    hashes.append(as_long(found[good]))
                    at.append(good.astype(np.int32))
                if any(map(len, at)):
                    rows.append((k, as_long(own), np.concatenate(hashes), np.concatenate(at)))
            chosen = batch.select(["doc_id", "text_hash"]).take(pa.array([r[0] for r in rows], pa.int64()))
            lists = [pa.array([r[j] for r in rows], pa.list_(x)) for j, x in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*chosen.columns, *lists], names=["doc_id", "text_hash", "words", "hashes", "at"])

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash binary, words array<long>, hashes array<long>, at array<int>")


def stretches(begins: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(first word, number of words, seeds) of where an item of n words may stand, from where its seeds let it begin.

    Seeds that could belong to one occurrence make one stretch, with room for an item before and behind.
    """
    begins = np.sort(begins)
    cut = [0, *(np.flatnonzero(np.diff(begins) > n) + 1).tolist(), len(begins)]
    spans = [(max(0, int(begins[a]) - n), int(begins[b - 1]) + 2 * n, b - a) for a, b in zip(cut, cut[1:])]
    return [(low, high - low, k) for low, high, k in spans]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word, last_word, seeds: every document that holds an item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = hashed(docs)
    items = scratch.write(item_words(benchmark).withColumn("key", F.monotonically_increasing_id()), "items")
    counts = scratch.write(word_counts(docs), "word-counts")
    total, n_docs = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0], docs.count()
    seeds = scratch.write(seeds_of(items, counts, total / max(1, n_docs), total), "seeds")
    scratch.drop("word-counts")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(GRAM))).distinct().collect())  # GRAM rows at most
    hits = scratch.write(hits_of(docs, Filter(seeds, seeds.count()), sizes).withColumn("row", F.monotonically_increasing_id()), "hits")
    flat = hits.select("row", F.explode(F.arrays_zip("hashes", "at")).alias("x")).select("row", F.col("x.hashes").alias("hash"), "x.at")
    met = flat.join(seeds, "hash").groupBy("row", "key").agg(F.first("n").alias("n"), F.collect_list(F.col("at") - F.col("place")).alias("begins"))

    def cut(batches):
        for batch in batches:
            rows = []
            for row, key, n, begins in zip(*(batch.column(c).to_pylist() for c in ("row", "key", "n")), arrays(batch.column("begins")), strict=True):
                rows += [(row, key, low, size, seeds) for low, size, seeds in stretches(begins, n)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate(types)], names=["row", "key", "low", "size", "seeds"])

    met = scratch.write(met.mapInArrow(cut, "row long, key long, low int, size int, seeds long"), "met")
    scratch.clear("items", "hits", "met")
    # a stretch is cut out where it meets its document, so that no document goes whole to each of its items
    words_at = hits.select("row", "doc_id", "text_hash", F.col("words").alias("all"))
    stretch = met.join(words_at, "row").select("row", "key", "doc_id", "text_hash", "low", "seeds", F.slice("all", F.col("low") + 1, F.col("size")).alias("of"))
    pairs = stretch.join(items.select("key", "item_id", F.col("words").alias("item")), "key")
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in batches:
            rows = []
            for k, (item, of, low, seeds) in enumerate(zip(*(arrays(batch.column(c)) for c in ("item", "of")), *(batch.column(c).to_pylist() for c in ("low", "seeds")), strict=True)):
                score, first, last = align(item, of)
                if score / (_MATCH * len(item)) >= threshold:
                    rows.append((k, score / (_MATCH * len(item)), low + first, low + last, seeds))
            chosen = batch.select(["row", "key", "doc_id", "text_hash", "item_id"]).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[j] for r in rows], pa.float64() if j == 1 else pa.int64()) for j in range(1, 5)]
            yield pa.RecordBatch.from_arrays([*chosen.columns, *columns], names=["row", "key", "doc_id", "text_hash", "item_id", "score", "first_word", "last_word", "seeds"])

    columns = ["row", "key", "doc_id", "text_hash", "item_id", "item", "of", "low", "seeds"]
    found = pairs.select(columns).mapInArrow(run, f"row long, key long, doc_id {kinds['doc_id']}, text_hash binary, item_id {kinds['item_id']}, score double, first_word long, last_word long, seeds long")
    # of a document's stretches the best, the first of equal ones
    own = ["doc_id", "text_hash", "item_id", "score", "first_word", "last_word", "seeds"]
    best = found.groupBy("row", "key").agg(F.max_by(F.struct(*own), F.struct("score", -F.col("first_word"))).alias("x"))
    return best.select("x.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
