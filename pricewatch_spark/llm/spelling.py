"""Spelling variant grouping: edits of the vocabulary, probed against broadcast Bloom filters.

Words are the runs of letters of all texts with their counts.  Two words are near if one inserted,
deleted or replaced code point turns one into the other.  Each word generates its deletions and
those replacements that put in a larger code point (so a near pair is generated once, from its
longer word or from its smaller one), as 64-bit hashes only: a deletion's or replacement's hash
follows from prefix sums of the word's own.  Only code points that occur in words are put in.

Hashes are probed against blocked Bloom filters: a word sets BITS bits in one block of 64 bytes.
There is a filter for each word length, and for each segment of a length that has very many words;
filters are built by Spark in pieces and broadcast together up to FILTER_BYTES, in several passes if
the vocabulary needs more, and a pass generates only edits of the lengths that it holds.  So what
is broadcast is bounded whatever the input.  Only positives are spelled out and shuffled, to an
exact join with the vocabulary, which removes false positives.

A word's form is its near word of largest count if that is FORM_TIMES its own at least; roots follow
forms to the last one by pointer jumping (counts grow tenfold a step, so four rounds reach every root).

Defined results: null and empty texts have no words; a null doc_id reads as an empty text in the
hash that misspells runs; repeated rows and copies count again; ties of count go to the smallest
word in code-point order; texts of any length are read whole; without words (an empty table) there
are no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, as_long, mix, table

NAME = "op12_spelling_variants"
ORACLE_SQL = None
SHORTEST, OCCURRENCES, FORM_TIMES = 7, 2, 10
#: One run in so many loses a code point.
MISSPELT = 31
#: Filters broadcast together; bits of a filter a word; bits that a word sets in its block of 512.
FILTER_BYTES, BITS_A_WORD, BITS, BLOCK = 32 << 20, 12, 4, 64
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Words whose edits a task probes.
PROBED_WORDS = 40_000
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % SHORTEST)
_BASE = np.uint64(0x9E3779B97F4A7C15)


# --- words --------------------------------------------------------------------------------------


def runs_of(doc_id, text: str) -> Counter:
    """Words of one text, misspelt where the hash says so, as UTF-8, with their counts.

    Maximal runs of fewer than SHORTEST letters give no word and are left out.
    """
    # bytes.lower() changes A-Z alone, and U+00C0 to U+00FF are C3 80 to C3 BF
    found = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower()))
    head = b"%d:" % doc_id if doc_id is not None else b":"
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(head + run)
        if h % MISSPELT == 0:
            letters = run.decode()
            at = h % len(letters)
            if len(letters) <= SHORTEST:
                continue
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n, length: all words of documents (doc_id, text) that occur OCCURRENCES times at least."""

    def run(batches):
        def rows(counts):
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    counts.update(runs_of(doc_id, text))
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    kept = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)
    return kept.select(F.col("word").cast("string").alias("word"), "n").withColumn("length", F.length("word"))


# --- hashes of words and of their edits -------------------------------------------------------------


def code_points(words: list[str], length: int) -> np.ndarray:
    """A row a word, all of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length, _BASE, np.uint64)]))


_CODE = mix(np.arange(1, 257, dtype=np.uint64))  # of each code point up to U+00FF


def weighted(letters: np.ndarray) -> np.ndarray:
    """Each row's sum before it is mixed."""
    length = letters.shape[1]
    return (_CODE[letters] * _powers(length)[:length]).sum(axis=1, dtype=np.uint64) + np.uint64(length)


def hashes(letters: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    return mix(weighted(letters))


def deletions(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, hash of the row without its i-th letter), each different result of a row once."""
    n, length = letters.shape
    terms = _CODE[letters] * _powers(length)[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    after = (before[:, -1:] - before[:, 1:]) * np.uint64(pow(int(_BASE), -1, 2**64))
    new = np.ones((n, length), bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # any letter of a run of equal ones gives the same
    row, i = np.nonzero(new)
    return row, i, mix(before[row, i] + after[row, i] + np.uint64(length - 1))


def replacements(letters: np.ndarray, whole: np.ndarray, i: int, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, k, hash of the row with by[k] in place of its i-th letter), where by[k] is the larger letter."""
    row, k = np.nonzero(by[None, :] > letters[:, i][:, None])
    step = (_CODE[by[k]] - _CODE[letters[row, i]]) * _powers(letters.shape[1])[i]
    return row, k, mix(whole[row] + step)


# --- blocked Bloom filters -------------------------------------------------------------------------


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, the 64-bit word in it that the hash's bits fall into) -> place of that word, and its bits."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    lane = low & np.uint64(7)
    bits = np.zeros(len(h), np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << ((low >> np.uint64(3 + 6 * k)) & np.uint64(63))
    return (block * np.uint64(8) + lane).astype(np.int64), bits


class Filter:
    """A blocked Bloom filter; a word's bits lie in one 64-bit lane of its block."""

    def __init__(self, blocks: int, lanes: np.ndarray | None = None):
        self.blocks = blocks
        self.lanes = np.zeros(blocks * 8, np.uint64) if lanes is None else lanes

    def add(self, h: np.ndarray) -> None:
        place, bits = _places(h, self.blocks)
        np.bitwise_or.at(self.lanes, place, bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        place, bits = _places(h, self.blocks)
        return (self.lanes[place] & bits) == bits


def blocks_for(words: int) -> int:
    return max(1, -(-words * BITS_A_WORD // (8 * BLOCK)))


def passes(lengths: dict[int, int], budget: int = FILTER_BYTES) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """Shards by pass: (length, segment) -> (segments of that length, blocks of its filter).

    lengths: how many words there are of each length.  Filters of one pass take budget bytes at most.
    """
    shards = []
    for length, words in sorted(lengths.items()):
        segments = -(-blocks_for(words) * BLOCK * 5 // (4 * budget))  # a segment may have a little more than its share
        shards += [((length, s), (segments, blocks_for(-(-words // segments)))) for s in range(segments)]
    out, room = [], 0
    for key, (segments, blocks) in shards:
        if not out or blocks * BLOCK > room:
            out.append({})
            room = budget
        out[-1][key] = (segments, blocks)
        room -= blocks * BLOCK
    return out


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (mix(h) % np.uint64(segments)).astype(np.int64)


def build_filters(vocabulary: DataFrame, shards: dict[tuple[int, int], tuple[int, int]], pieces: int) -> dict[tuple[int, int], Filter]:
    """The filters of one pass.  Each piece is a range of blocks of all filters, built where its words
    meet, so what comes to the driver is as large as the filters."""

    segments = {length: count for (length, _), (count, _) in shards.items()}

    def addressed(batches):
        for batch in batches:
            words, sizes = batch.column("word").to_pylist(), batch.column("length").to_numpy()
            for length in np.unique(sizes).tolist():
                places = np.flatnonzero(sizes == length).tolist()
                h = hashes(code_points([words[k] for k in places], length))
                at = _segment(h, segments[length])
                for s in np.unique(at).tolist():
                    if (length, s) in shards:
                        mine, blocks = h[at == s], shards[length, s][1]
                        piece = _places(mine, blocks)[0] * pieces // (blocks * 8)
                        of = [pa.array(np.full(len(mine), x, np.int32)) for x in (length, s)]
                        yield pa.RecordBatch.from_arrays([*of, pa.array(piece.astype(np.int32)), pa.array(as_long(mine))], names=["length", "segment", "piece", "h"])

    def lanes(key, pdf):
        length, segment, piece = (int(x) for x in key)
        blocks = shards[length, segment][1]
        place, bits = _places(pdf["h"].to_numpy().view(np.uint64), blocks)
        first = -(-piece * blocks * 8 // pieces)
        own = np.zeros(int(place.max()) + 1 - first, np.uint64)
        np.bitwise_or.at(own, place - first, bits)
        return type(pdf)({"length": [length], "segment": [segment], "first": [first], "lanes": [own.tobytes()]})

    wanted = sorted({length for length, _ in shards})
    rows = vocabulary.where(F.col("length").isin(wanted)).select("word", "length").mapInArrow(addressed, "length int, segment int, piece int, h long")
    built = rows.groupBy("length", "segment", "piece").applyInPandas(lanes, "length int, segment int, first long, lanes binary")
    out = {key: Filter(blocks) for key, (_, blocks) in shards.items()}
    for r in built.toLocalIterator():  # FILTER_BYTES in all
        own = np.frombuffer(r["lanes"], np.uint64)
        out[r["length"], r["segment"]].lanes[r["first"] : r["first"] + len(own)] = own
    return out


# --- near words --------------------------------------------------------------------------------------


def candidates(vocabulary: DataFrame, filters: dict[tuple[int, int], Filter], shards: dict[tuple[int, int], tuple[int, int]], alphabet: np.ndarray, tasks: int) -> DataFrame:
    """word, n, other: edits of words that a filter holds."""
    shared = vocabulary.sparkSession.sparkContext.broadcast({k: f.lanes for k, f in filters.items()})
    segments = {length: count for (length, _), (count, _) in shards.items()}

    def run(batches):
        probes = {k: Filter(shards[k][1], lanes) for k, lanes in shared.value.items()}

        def held(length, row, column, h):
            """Those (row, column) whose hash the length's filters hold."""
            hit, at = np.zeros(len(h), bool), _segment(h, segments[length])
            for (x, s), probe in probes.items():
                if x == length:
                    mine = np.flatnonzero(at == s) if segments[length] > 1 else slice(None)
                    hit[mine] = probe.holds(h[mine])
            return zip(row[hit].tolist(), column[hit].tolist(), strict=True)

        for batch in batches:
            words, counts, sizes = batch.column("word").to_pylist(), batch.column("n").to_pylist(), batch.column("length").to_numpy()
            for length in np.unique(sizes).tolist():
                places = np.flatnonzero(sizes == length).tolist()
                step = max(1, (1 << 16) // length)
                for at in range(0, len(places), step):
                    mine = places[at : at + step]
                    letters = code_points([words[k] for k in mine], length)
                    rows: list[tuple[int, str]] = []
                    if length - 1 in segments:
                        rows += [(mine[r], words[mine[r]][:i] + words[mine[r]][i + 1 :]) for r, i in held(length - 1, *deletions(letters))]
                    if length in segments:
                        whole = weighted(letters)
                        for i in range(length):
                            found = held(length, *replacements(letters, whole, i, alphabet))
                            rows += [(mine[r], words[mine[r]][:i] + chr(alphabet[k]) + words[mine[r]][i + 1 :]) for r, k in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[k] for k, _ in rows], pa.string()), pa.array([counts[k] for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], names=["word", "n", "other"]
                    )

    probing = sorted({x for length in segments for x in (length, length + 1)})
    return vocabulary.where(F.col("length").isin(probing)).repartition(tasks, "word").mapInArrow(run, "word string, n long, other string")


def near_words(vocabulary: DataFrame, budget: int = FILTER_BYTES) -> DataFrame:
    """vocabulary (word, n, length), a written table -> word, n, other, other_n: near pairs, in both directions."""
    counts = {r["length"]: r["count"] for r in vocabulary.groupBy("length").count().collect()}  # a row a length of word
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint64)  # 90 at most
    found = []
    for shards in passes(counts, budget):
        filters = build_filters(vocabulary, shards, max(1, sum(blocks for _, blocks in shards.values()) * BLOCK >> 20))
        found.append(candidates(vocabulary, filters, shards, alphabet, max(1, -(-sum(counts.values()) // PROBED_WORDS))))
    if not found:
        return vocabulary.selectExpr("word", "n", "word AS other", "n AS other_n")
    others = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = reduce(DataFrame.unionByName, found).join(others, "other").select("word", "n", "other", "other_n")
    return pairs.unionByName(pairs.selectExpr("other AS word", "other_n AS n", "word AS other", "n AS other_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """forms (word, form) -> word, root: the end of the chain of forms, in rounds that double the step."""
    step, level = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        level += 1
        moved = scratch.write(moved, f"roots-{level}")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def spelling_variants(spark: SparkSession, docs: DataFrame, budget: int = FILTER_BYTES) -> DataFrame:
    """docs (doc_id, text) -> word, n, n_near, form, form_n, root: one row a word."""
    scratch = Scratch(spark, "spelling")
    vocabulary = scratch.write(word_counts(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))  # the largest count, then the smallest word
    near = scratch.write(near_words(vocabulary, budget).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    enough = -F.col("best.n") >= F.col("n") * FORM_TIMES
    rows = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    rows = scratch.write(rows, "forms")
    ends = roots(rows.where("form is not null"), scratch)
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, table(spark, sf_dir, "documents"))
