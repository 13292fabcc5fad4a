"""The current state of all listings on disk: versions that share the buckets which did not change.

A store has buckets by hash of the listing key.  Committing a version writes only the buckets that it
names, into the version's own folder, and then a manifest that says of every bucket which version
wrote it last; readers follow the newest manifest that is complete, so they never see half a version,
and a commit that is run again overwrites its own folders.  The number of buckets follows the size:
when they hold more than rows_a_bucket on average the whole is written once with twice as many (each
bucket splits in two), so a batch always touches small parts and the writing has many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.operators.delta import KEY

ENTRY = "bucket int, version long, n long, buckets int"


class Manifest(NamedTuple):
    """The number of buckets, and of each bucket that has rows the version that wrote it and its rows."""

    buckets: int
    written: dict[int, tuple[int, int]]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.written.values())


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 8, rows_a_bucket: int = 1_000_000):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.first_buckets, self.rows_a_bucket = buckets, rows_a_bucket

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, *parts: str) -> None:
        path, fs = self._path(*parts)
        fs.delete(path, True)

    def versions(self) -> list[int]:
        """Versions whose manifests are complete."""
        found = []
        for name in self._children("manifests"):
            path, fs = self._path("manifests", name, "_SUCCESS")
            if fs.exists(path):
                found.append(int(name.removeprefix("v")))
        return found

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, of the newest if None; of an empty store before the first."""
        known = self.versions()
        version = max(known, default=None) if version is None else version
        if version not in known:
            return Manifest(self.first_buckets, {})
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifests/v{version:09d}").collect()  # a row a bucket
        return Manifest(rows[0]["buckets"], {r["bucket"]: (r["version"], r["n"]) for r in rows if r["bucket"] is not None})

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")

    def read(self, manifest: Manifest | None = None, only: set[int] | None = None) -> DataFrame:
        """All listings, or those of some buckets."""
        manifest = self.manifest() if manifest is None else manifest
        paths = [f"{self.root}/data/v{v:09d}/bucket={b}" for b, (v, _) in sorted(manifest.written.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame, manifest: Manifest) -> set[int]:
        """The buckets of some listings."""
        return {r[0] for r in keys.select(self.bucket(manifest.buckets)).distinct().collect()}  # a row a bucket

    def commit(self, version: int, rows: DataFrame, before: Manifest, replaced: set[int] | None) -> Manifest:
        """A version in which rows stand for all listings of the replaced buckets (None: of the store);
        the other buckets stay as before has them.  rows hold listings of replaced buckets alone."""
        data = f"{self.root}/data/v{version:09d}"
        columns = self.spark.createDataFrame([], self.schema).columns
        dealt = rows.select(*columns).withColumn("bucket", self.bucket(before.buckets))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        counts = {r["bucket"]: (version, r["n"]) for r in self.spark.read.schema(self.schema + ", bucket int").parquet(data).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        kept = {} if replaced is None else {b: x for b, x in before.written.items() if b not in replaced}
        after = Manifest(before.buckets, kept | counts)
        if after.rows > self.rows_a_bucket * after.buckets:
            after = self._split(version, after)
        entries = [(b, v, n, after.buckets) for b, (v, n) in after.written.items()] or [(None, version, 0, after.buckets)]
        self.spark.createDataFrame(entries, ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/v{version:09d}")
        return after

    def _split(self, version: int, manifest: Manifest) -> Manifest:
        """The store with so many buckets that they hold rows_a_bucket or less, in folders of the version's own."""
        buckets = manifest.buckets
        while manifest.rows > self.rows_a_bucket * buckets:
            buckets *= 2
        # bucket folders of a version may be both read and written here, so the split has a version of its own
        own = -version - 1
        data = f"{self.root}/data/v{own:09d}"
        self.read(manifest).withColumn("bucket", self.bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        counts = self.spark.read.schema(self.schema + ", bucket int").parquet(data).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        return Manifest(buckets, {r["bucket"]: (own, r["n"]) for r in counts})

    def collect(self, keep: int = 2) -> int:
        """Delete manifests but the newest ones, and bucket folders that none of those needs; how many folders went."""
        known = self.versions()
        kept = known[-keep:] if keep else []
        needed = {(v, b) for version in kept for b, (v, _) in self.manifest(version).written.items()}
        for version in known:
            if version not in kept:
                self._delete("manifests", f"v{version:09d}")
        gone = 0
        newest = max(kept, default=-1)
        for name in self._children("data"):
            version = int(name.removeprefix("v"))
            if version > newest or -version - 1 > newest:
                continue  # another commit may be under way
            for bucket in self._children("data", name):
                if bucket.startswith("bucket=") and (version, int(bucket.removeprefix("bucket="))) not in needed:
                    self._delete("data", name, bucket)
                    gone += 1
        return gone


def upsert_version(store: SnapshotStore, version: int, keys: DataFrame, step, whole: bool = False) -> Manifest:
    """One version: step(listings of the buckets that keys touch) gives these listings anew.

    whole: all buckets are looked at and written, for changes that reach listings without a row.
    """
    before = store.manifest(max((v for v in store.versions() if v < version), default=-1))
    touched = None if whole else store.touched(keys, before)
    return store.commit(version, step(store.read(before, touched)), before, touched)


def save_bucketed(snapshot: DataFrame, name: str, buckets: int) -> None:
    """The snapshot as a table of the catalog, bucketed and sorted by the listing key: a batch that is
    dealt into as many partitions by the key meets it without an exchange on the table's side."""
    snapshot.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
