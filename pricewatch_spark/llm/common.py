"""What the operators share: tables, the shared folder, hashing of words and bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables of one job in the shared folder; reading one back cuts the lineage."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def clear(self, *keep: str) -> None:
        """Delete all tables but those that a result still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for table_ in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if table_.getPath().getName() not in keep:
                self.drop(table_.getPath().getName())


def remainder(n: int):
    """crc32 of the decimal doc_id, modulo n: the split between learning and held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def texts(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


# --- hashing ---------------------------------------------------------------------------------

_RANDOM = np.random.default_rng(20240607)
BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SECOND = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        up = np.full(1 << max(16, int(n).bit_length()), BASE, np.uint64)
        down = np.full(len(up), BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values (wrapping polynomial, then mixed)."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count])


def raw_bytes(text: str | bytes | None) -> np.ndarray:
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(data, np.uint8)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\x09-\\x0D."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, with the words' starts and ends in bytes."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def minimisers(hashes: np.ndarray, w: int, at: np.ndarray | None = None) -> np.ndarray:
    """For each window of w consecutive hashes, the position of its smallest (leftmost of equal).

    Windows with equal content choose the same place within them, whatever text they lie in: whole
    hashes are compared, and of equal ones the leftmost counts.  at: the windows' starts, all if None.
    """
    count = len(hashes) - w + 1
    if count <= 0:
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    # the upper bits with the place, which nearly always tell; then the windows that whole hashes decide otherwise
    found = (_sliding_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), w) & low).astype(np.int64)
    for i in np.flatnonzero(hashes[found] != _sliding_minima(hashes, w)):
        found[i] = i + int(hashes[i : i + w].argmin())
    return found if at is None else found[at]


def _sliding_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive keys."""
    count, width = len(keys) - w + 1, 1
    while width * 2 <= w:
        keys = np.minimum(keys[: len(keys) - width], keys[width:])
        width *= 2
    return np.minimum(keys[:count], keys[w - width : w - width + count]) if width < w else keys[:count]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
