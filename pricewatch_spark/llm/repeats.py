"""What the two exact repeat finders share: anchors, and the counting of them.

A window of ``length`` units (words or bytes) is seen through its anchor: of the shorter windows
of ``size`` units within it, the one with the smallest hash.  Equal windows have equal anchors at
equal places, so a window can only repeat if its anchor does.  Anchors are counted over all
distinct texts, weighted by the number of copies; no window that repeats is lost.

Texts are told apart by their MD5; of equal texts one (smallest doc_id) takes part, with its
number of copies.  Should several rows share text and doc_id they all take part: harmless, since
such windows repeat anyway.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import BYTE_CODE, Scratch, as_long, minimisers, raw_bytes, texts, windows, word_hashes


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text ('' for null), text_hash."""
    return texts(docs).withColumn("text_hash", F.unhex(F.md5(F.col("text").cast("binary"))))


def units(text: str, kind: str) -> np.ndarray:
    return word_hashes(raw_bytes(text))[0] if kind == "words" else BYTE_CODE[raw_bytes(text)]


def anchors(of: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the windows of size units, for each window of length units its anchor)."""
    if len(of) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = windows(of, size)
    return hashes, minimisers(hashes, length - size + 1)


def anchored(docs: DataFrame, kind: str, length: int, size: int, scratch: Scratch) -> DataFrame:
    """One row a distinct text with an anchor: id, text_hash, doc_id, copies, fps, at."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            fps, at = [], []
            for text in batch.column("text").to_pylist():
                hashes, found = anchors(units(text, kind), length, size)
                found = np.unique(found)
                fps.append(as_long(hashes[found]))
                at.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "fps", "at"],
            )

    every = scratch.write(hashed(docs).mapInArrow(run, f"doc_id {id_type}, text_hash binary, fps array<long>, at array<int>"), "anchors")
    heads = every.groupBy("text_hash").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    scratch.write(heads.where("copies > 1").select("text_hash"), "copied")
    own = every.join(heads.withColumnRenamed("text_hash", "h"), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("head")))
    out = scratch.write(
        own.where(F.size("fps") > 0).select(F.monotonically_increasing_id().alias("id"), "text_hash", "doc_id", "copies", "fps", "at"), "texts"
    )
    scratch.drop("anchors")
    return out


def copied(scratch: Scratch) -> DataFrame:
    """text_hash of the texts with more than one copy, as ``anchored`` wrote it."""
    return scratch.spark.read.schema("text_hash binary").parquet(f"{scratch.root}/copied")


def surviving(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows (id, copies, fps, at) -> (id, at): the places whose hash occurs at least twice.

    The repeated hashes are written first: the join then reads both sides from exchanges of its
    own, so Spark can split a very frequent hash among tasks.
    """
    flat = rows.select("id", "copies", F.explode(F.arrays_zip("fps", "at")).alias("x")).select("id", "copies", "x.fps", "x.at")
    again = flat.groupBy("fps").agg(F.sum("copies").alias("n")).where("n >= 2").select("fps")
    again = scratch.write(again, f"repeated-{name}")
    return flat.join(again, "fps", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("at")).alias("at"))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def alive(found: np.ndarray, at: list[int], size: int) -> np.ndarray:
    """Which windows have their anchor among the surviving places."""
    good = np.zeros(size, bool)
    good[np.asarray(at, np.int64)] = True
    return good[found]


def with_text(docs: DataFrame, survivors: DataFrame, rows: DataFrame) -> DataFrame:
    """id, copies, text, at: the surviving texts themselves."""
    keys = rows.select("id", "copies", F.col("text_hash").alias("h"), F.col("doc_id").alias("d")).join(survivors, "id")
    own = hashed(docs).join(keys, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return own.select("id", "copies", "text", "at")


def covered(starts: list[int] | np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of size units are covered by windows of length units that begin at starts."""
    step = np.zeros(size + 1, np.int32)
    begin = np.asarray(starts, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, np.minimum(begin + length, size), -1)
    return np.cumsum(step[:size]) > 0


def covered_runs(lows: np.ndarray, highs: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of size units are covered by windows that begin in one of the runs low <= begin < high."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, lows, 1)
    np.add.at(step, np.minimum(highs - 1 + length, size), -1)
    return np.cumsum(step[:size]) > 0


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array; null is empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]
