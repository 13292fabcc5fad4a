"""Tables: reads, archives, exports, upserts by key."""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.constants import EXPORT_COLUMNS


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share; one of our own only in local mode."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """df, evaluated once and kept in the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of one job in the checkpoint folder, by column and compressed: a fraction of what a checkpoint takes.

    They stay until they are cleared; what a result reads has to stay until the result is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []

    def deal(self, df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *by)

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """df, evaluated once and read back; with by, rows that deal has dealt so are read back without an exchange."""
        name = f"kept_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        writer = df.write.format("parquet").option("compression", "zstd")
        if by:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            writer.option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
            found = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside of the warehouse
        else:
            writer.save(path)
            found = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((found, path))
        release(self.spark)
        return found

    def clear(self, *but: DataFrame) -> None:
        """Delete all tables but those that later plans read."""
        gone = [path for found, path in self.tables if not any(found is x for x in but)]
        self.tables = [(found, path) for found, path in self.tables if path not in gone]
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, gone):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def load_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None, partition_column: str | None = None, rows_a_partition: int = 1_000_000, connections: int = 64) -> DataFrame:
    """A table from parquet, or through JDBC (jdbc: its options).

    partition_column, a number, date or timestamp, cuts the table into ranges that are read side by side: its bounds and
    the number of rows are asked of the database, which gives a range a million rows, and at most 64 ranges since each is
    a connection.  Rows outside of the bounds and nulls are read as well.  Filters and columns go to the database.
    """
    if not jdbc:
        return spark.read.parquet(f"{path}/{name}.parquet")
    cut = {}
    if partition_column is not None:
        asked = f"SELECT MIN({partition_column}) AS low, MAX({partition_column}) AS high, COUNT(*) AS n FROM {name}"
        found = spark.read.format("jdbc").options(**jdbc).option("query", asked).load().toDF("low", "high", "n")
        if dict(found.dtypes)["low"] not in ("date", "timestamp", "timestamp_ntz"):
            found = found.withColumns({"low": F.floor("low"), "high": F.ceil("high")})
        low, high, n = found.select(F.col("low").cast("string"), F.col("high").cast("string"), F.col("n").cast("long")).first()
        parts = min(-(-n // rows_a_partition), connections)
        if low is not None and parts > 1:
            cut = {"partitionColumn": partition_column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**jdbc).options(dbtable=name, **cut).load()


def _by_run(rows: DataFrame, path: str, run_id: str | None):
    """Where and how a run's rows go: a folder of their own, overwritten if the run is repeated; appended without a run."""
    if run_id is None:
        return rows.write.mode("append"), path
    return rows.drop("run_id").write.mode("overwrite"), f"{path}/run_id={quote(run_id, safe='')}"


def archive_raw(raw: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None) -> None:
    """A run's raw rows, by source and day.  With run_id, a run that is repeated takes the place of what it wrote before."""
    writer, folder = _by_run(raw.withColumn("run_date", F.to_date("scraped_at")), path, run_id)
    writer.partitionBy("source_id", "run_date").format(fmt).save(folder)


def replay_raw(spark: SparkSession, path: str, source_id: str | None = None, day: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Archived rows; the filters prune folders."""
    rows = spark.read.format(fmt).load(path)
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    return rows if day is None else rows.where(F.col("run_date") == F.lit(day).cast("date"))


def export_catalog(raw: DataFrame, path: str, fmt: str = "csv") -> None:
    """Eleven columns in their fixed order; CSV has no arrays, so tags are joined there."""
    rows = raw.select(*EXPORT_COLUMNS)
    if fmt == "csv":
        rows.withColumn("tags", F.array_join("tags", ", ")).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes put in by key; a null in changes keeps what was there."""
    values = [c for c in current.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"n_{c}") for c in values if c in changes.columns))
    both = current.join(new, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(f"n_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in values))


def upsert_listings(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(snapshot, changes, ["source_id", "source_external_id"])


def append_history(rows: DataFrame, path: str, run_id: str | None = None) -> None:
    """Appended by month.  With run_id, a run that is repeated takes the place of what it wrote before."""
    writer, folder = _by_run(rows.withColumn("recorded_month", F.date_format("recorded_at", "yyyy-MM")), path, run_id)
    writer.partitionBy("recorded_month").parquet(folder)


def upsert_sources(current: DataFrame, new: DataFrame) -> DataFrame:
    """By name: url, engine and config (where both tables have one) are taken over and the source is active again."""
    taken = ["base_url", "engine_type"] + [c for c in ("config",) if c in current.columns and c in new.columns]
    fresh = new.select("name", *(F.col(c).alias(f"n_{c}") for c in taken), F.lit(True).alias("n_is_active"))
    both = current.join(fresh, "name", "full_outer")
    known = F.col("n_is_active").isNotNull()
    put = lambda c: F.when(known, F.col(f"n_{c}")).otherwise(F.col(c))
    return both.withColumns({c: put(c) for c in (*taken, "is_active")}).drop(*(f"n_{c}" for c in (*taken, "is_active")))


def new_sources(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose name isn't taken."""
    return new.join(current.select("name"), "name", "left_anti")
