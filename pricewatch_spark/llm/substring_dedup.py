"""Substring dedup by level-wise doubling over word windows.

Windows of a quarter of the target length are counted first, seen through anchors (see repeats).
Only windows that repeat at one length are extended to twice that length and counted again, until
the target is reached or no candidate survives.  From the first level on only the surviving
stretches are carried, as word hashes.  The last level counts every surviving window of the
target length by 128 bits; its windows that occur at least twice are removed.

Defined results: null texts have no words; texts shorter than a window lose nothing; all windows
of a text that has a copy repeat, so such a text is removed whole if it has a window; repeated
rows are documents of their own; null doc_ids are kept; very long texts are taken whole; there are
no ties, since every copy of a window goes; an empty table gives no rows; further columns of the
input are ignored, whatever their names.  kept_sha256 is of the kept words joined by one space;
kept_text is the text without the words that go and the blanks after them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch_spark.llm.common import Scratch, as_long, mix, raw_bytes, table, windows, word_hashes
from pricewatch_spark.llm.repeats import alive, anchored, anchors, copied, covered, runs, surviving, units, with_text

NAME = "op9_substring_dedup"
WINDOW = 35
ORACLE_SQL = None


def levels(window: int) -> list[int]:
    """A quarter of the window, then twice as long each time, the last one the window itself."""
    out = [-(-window // 4)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def _stretches(rows: DataFrame, window: int, size: int, first: bool) -> DataFrame:
    """The surviving stretches: id of the text, copies, start (in words), words (hashes)."""

    def run(batches):
        for batch in batches:
            ids, copies, begin, words = [], [], [], []
            offsets = batch.column("start").to_pylist() if not first else [0] * batch.num_rows
            content = batch.column("text" if first else "words").to_pylist()
            for i, n, off, body, at in zip(batch.column("id").to_pylist(), batch.column("copies").to_pylist(), offsets, content, batch.column("at").to_pylist(), strict=True):
                of = units(body, "words") if first else np.frombuffer(body, np.uint64)
                hashes, found = anchors(of, window, size)
                for s, e in zip(*runs(alive(found, at, len(hashes))), strict=True):
                    ids.append(i)
                    copies.append(n)
                    begin.append(off + int(s))
                    words.append(of[s : e + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(begin, pa.int32()), pa.array(words, pa.binary())],
                names=["text_id", "copies", "start", "words"],
            )

    return rows.mapInArrow(run, "text_id long, copies long, start int, words binary")


def _next_anchors(stretches: DataFrame, window: int, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps, at = [], []
            for body in batch.column("words").to_pylist():
                hashes, found = anchors(np.frombuffer(body, np.uint64), window, size)
                found = np.unique(found)
                fps.append(as_long(hashes[found]))
                at.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), pa.array(fps, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], names=["id", "copies", "fps", "at"]
            )

    return stretches.select("id", "copies", "words").mapInArrow(run, "id long, copies long, fps array<long>, at array<int>")


def _full_windows(stretches: DataFrame, window: int) -> DataFrame:
    """text_id, copies, a, b (128 bits of each window), at (its start in the text)."""

    def run(batches):
        for batch in batches:
            ids, copies, a, b, at = [], [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("text_id", "copies", "start", "words")), strict=True)
            for i, n, start, body in rows:
                of = np.frombuffer(body, np.uint64)
                first = windows(of, window)
                ids.append(np.full(len(first), i, np.int64))
                copies.append(np.full(len(first), n, np.int64))
                a.append(as_long(first))
                b.append(as_long(windows(mix(of ^ np.uint64(0xA5A5F00D1234567)), window)))
                at.append(np.arange(start, start + len(first), dtype=np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, copies, a, b, at)], names=["text_id", "copies", "a", "b", "at"])

    return stretches.select("text_id", "copies", "start", "words").mapInArrow(run, "text_id long, copies long, a long, b long, at int")


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """text_hash, starts: the windows, by first word, that repeat in texts without a copy."""
    steps = levels(window)
    texts_ = anchored(docs, "words", window, steps[0], scratch)
    stretches = scratch.write(_stretches(with_text(docs, surviving(texts_, scratch, "0"), texts_), window, steps[0], True), "level-0")
    for k, size in enumerate(steps[1:-1], 1):
        numbered = scratch.write(stretches.withColumn("id", F.monotonically_increasing_id()), f"numbered-{k}")
        scratch.drop(f"level-{k - 1}")
        again = surviving(_next_anchors(numbered, window, size), scratch, str(k))
        named = numbered.select(F.col("id").alias("key"), F.col("text_id").alias("id"), "copies", "start", "words")
        following = _stretches(named.join(again.withColumnRenamed("id", "key"), "key"), window, size, False)
        stretches = scratch.write(following, f"level-{k}")
        scratch.drop(f"numbered-{k}")
        if stretches.isEmpty():
            break
    found = _full_windows(stretches, window)
    again = found.groupBy("a", "b").agg(F.sum("copies").alias("n")).where("n >= 2").select("a", "b")
    again = scratch.write(again, "repeated-windows")  # so that Spark can split frequent windows in the join
    single = found.where("copies = 1").join(again, ["a", "b"], "left_semi").groupBy(F.col("text_id").alias("id")).agg(F.collect_list("at").alias("starts"))
    return texts_.select("id", "text_hash").join(single, "id").select("text_hash", "starts")


def removals(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """text_hash, whole, starts: what goes, for the texts that lose something."""
    once = repeated_windows(docs, window, scratch).select("text_hash", F.lit(False).alias("whole"), "starts")
    return once.unionByName(copied(scratch).select("text_hash", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts")))


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id alone if None) with n_words, n_removed, kept_sha256 and, if
    asked for, kept_text."""
    scratch = Scratch(spark, "substring-dedup")
    marks = scratch.write(removals(docs, window, scratch), "marks")
    scratch.clear("marks")
    keep = keep or ["doc_id"]
    fields = [f for f in docs.schema if f.name in keep]
    names = ["n_words", "n_removed", "kept_sha256", "kept_text"][: 4 if keep_text else 3]

    def run(batches):
        for batch in batches:
            n, removed, kept, left = [], [], [], []
            for text, whole, starts in zip(*(batch.column(c).to_pylist() for c in ("_body", "_whole", "_starts")), strict=True):
                data = raw_bytes(text)
                _, begin, end = word_hashes(data)
                gone = np.zeros(len(begin), bool)
                if whole and len(begin) >= window:
                    gone[:] = True
                elif starts:
                    gone = covered(starts, window, len(begin))
                raw = data.tobytes()
                n.append(len(begin))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([raw[a:b] for a, b in zip(begin[~gone].tolist(), end[~gone].tolist(), strict=True)]))
                if keep_text:
                    first = begin[0] if len(begin) else len(data)
                    stay = np.repeat(~gone, np.diff(begin, append=len(data)))  # a word that goes takes the blanks after it along
                    left.append(raw[:first] + data[first:][stay].tobytes())
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            if keep_text:
                columns.append(pa.array([x.decode("utf-8", "replace") for x in left], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *columns], names=[*(f.name for f in fields), *names])

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_body")
    rows = docs.select(*(f.name for f in fields), body).withColumn("_hash", F.unhex(F.md5(F.col("_body").cast("binary"))))
    joined = rows.join(marks.select(F.col("text_hash").alias("_hash"), F.col("whole").alias("_whole"), F.col("starts").alias("_starts")), "_hash", "left")
    kinds = {"kept_sha256": T.StringType(), "kept_text": T.StringType()}
    return joined.drop("_hash").mapInArrow(run, T.StructType([*fields, *(T.StructField(x, kinds.get(x, T.LongType())) for x in names)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents"))
