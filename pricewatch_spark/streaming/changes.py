"""Change detection on streams: micro-batches against the snapshot, or keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructField, StructType

from pricewatch_spark.functions.text import MONEY
from pricewatch_spark.operators import delta
from pricewatch_spark.sources.snapshots import SnapshotStore, upsert_version
from pricewatch_spark.sources.tables import Scratch

SNAPSHOT = (
    "source_id string, source_external_id string, current_hash string, current_price decimal(12,2), current_stock int, availability string, "
    "stock_confidence string, url string, image_url string, currency string, last_confirmed_stock_at timestamp, last_seen_at timestamp, "
    "moq int, bulk_tiers array<struct<qty int, price decimal(12,2)>>, title string, last_scraped_at timestamp"
)
EMITTED = "source_id string, source_external_id string, at long, change string, price string, availability string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_snapshot(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """The snapshot after a batch of run_delta_stream, after the last one if None."""
    store = SnapshotStore(spark, f"{root}/snapshot", SNAPSHOT)
    return store.read(store.manifest(batch))


def run_delta_stream(
    raw_stream: DataFrame, sources: DataFrame, root: str, checkpoint: str, delist_minutes: int | None = None, buckets: int = 8, rows_a_bucket: int = 1_000_000, keep: int = 3
) -> StreamingQuery:
    """Each micro-batch commits a version of the snapshot and writes its history.

    Only the buckets that the batch touches are read and written, and buckets hold rows_a_bucket
    listings at most on average, so a batch costs what it touches (with delist_minutes every bucket is
    looked at).  The batch and its changes, dealt by listing, are kept in the checkpoint folder while the
    batch lasts, since buckets, snapshot and history all read them.  A batch that is run again starts from
    the version before it and overwrites what it has written; versions older than the last ones are deleted.
    sources, a row a shop, is broadcast.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = SnapshotStore(spark, f"{root}/snapshot", SNAPSHOT, buckets, rows_a_bucket)
        kept = Scratch(spark)
        observed = kept.keep(delta.observe(batch, F.broadcast(sources)).select(*delta.KEY, "scraped_at", "pos", *delta.FACTS))
        newest = observed.agg(F.max("scraped_at")).first()[0] if delist_minutes is not None else None

        def after(before: DataFrame) -> DataFrame:
            changes = kept.keep(delta.classify_changes(observed, before), *delta.KEY)
            delta.history_rows(changes).write.mode("overwrite").parquet(f"{root}/history/batch={batch_id:09d}")
            state = delta.next_snapshot(changes, before)
            return state if newest is None else delta.delist_stale(state, F.lit(newest), delist_minutes)

        upsert_version(store, batch_id, observed, after, whole=newest is not None)
        store.collect(keep)
        kept.clear()

    return raw_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A row of a listing as it waits or as it was last seen; tables of such rows are the state of a group of listings.
ROW = pa.schema([("source_id", pa.string()), ("source_external_id", pa.string()), ("at", pa.int64()), ("pos", pa.string()), ("hash", pa.string()), ("price", pa.string()), ("availability", pa.string())])


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(blobs: Iterator[tuple]) -> pa.Table:
    return pa.concat_tables([ROW.empty_table(), *(pa.ipc.open_stream(bytes(x[0])).read_all() for x in blobs)])


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for rows that are equal in all columns, nulls alike."""
    out = np.zeros(len(columns[0]), "int64")
    for c in columns:
        one = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1]
    return out


def _in_order(rows: pa.Table, at: np.ndarray, listing: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Rows by listing: what was known, then by time; pos, a long text, is only asked at equal times."""
    order = np.lexsort((at, fresh, listing))
    same = (np.diff(listing[order]) == 0) & (np.diff(at[order]) == 0) & (np.diff(fresh[order]) == 0)
    tied = np.r_[same, False] | np.r_[False, same]
    if tied.any():
        some = order[tied]
        place = np.unique(np.array([x or "" for x in rows["pos"].take(some).to_pylist()], object), return_inverse=True)[1]
        order[tied] = some[np.lexsort((place, at[some], fresh[some], listing[some]))]
    return order


class ListingStates(StatefulProcessor):
    """The states of a group of listings in event time.

    Rows wait in the group's state until the watermark has passed them and are then played in the
    order of (time, pos), so what is emitted does not depend on how rows fell into batches; only the
    watermark's delay decides which rows come too late.  A timer stands at the earliest thing to do:
    play a row, emit a silence, forget a listing.  All listings of a group are played at once, column by column.
    """

    def __init__(self, silent: int, forget: int | None, revive: bool):
        self.silent, self.forget, self.revive = silent, forget, revive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        failed = new["failed"].to_numpy(bool)
        if not failed.all():
            kept = pa.Table.from_pandas(new.loc[~failed, ROW.names], ROW, preserve_index=False).replace_schema_metadata()
            self.waiting.appendList([_packed(kept)])
            self._wake(-(-pc.min(kept["at"]).as_py() // 1000), False)
        if failed.any():
            lost = pa.Table.from_pandas(new.loc[failed, ROW.names], ROW, preserve_index=False)
            yield _emitted([(lost, lost["at"].to_numpy(), "failed")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked(self.waiting.get()) if self.waiting.exists() else ROW.empty_table()
        is_ready = pc.less_equal(waiting["at"], now)
        ready, later = waiting.filter(is_ready), waiting.filter(pc.invert(is_ready))
        before = _unpacked([self.known.get()] if self.known.exists() else [])
        known, delisted, out = self._played(pa.concat_tables([before, ready]), before.num_rows, now)
        if ready.num_rows:
            self.waiting.put([_packed(later)]) if later.num_rows else self.waiting.clear()
        self.known.update(_packed(known)) if known.num_rows else self.known.clear()
        seen = known["at"].to_numpy()
        due = [-(-pc.min(later["at"]).as_py() // 1000)] if later.num_rows else []
        due += [(int(seen[~delisted].min()) + self.silent) // 1000 + 1] if not delisted.all() else []
        if self.forget is not None and delisted.any():
            due.append((int(seen[delisted].min()) + self.silent + self.forget) // 1000 + 1)
        if due:
            self._wake(min(due), True)
        if sum(rows.num_rows for rows, _, _ in out):
            yield _emitted(out)

    def _played(self, rows: pa.Table, n_known: int, now: int) -> tuple[pa.Table, np.ndarray, list]:
        """rows: what is known of listings (the first n_known), then rows to play -> what is known after them
        and whether it is delisted, and what is emitted: rows, times, change."""
        at, fresh = rows["at"].to_numpy(), np.arange(rows.num_rows) >= n_known
        listing = _codes(rows["source_id"], rows["source_external_id"])
        order = _in_order(rows, at, listing, fresh)
        rows, at, fresh, listing = rows.take(order), at[order], fresh[order], listing[order]
        hash_ = _codes(rows["hash"])
        follows = np.r_[False, listing[1:] == listing[:-1]][: len(at)]  # the row before is of the same listing
        since = at - np.r_[at[:1], at[:-1]]
        silent = follows & (since > self.silent)
        gone = follows & (since > self.silent + self.forget) if self.forget is not None else np.zeros(len(at), bool)
        lasts = follows & ~gone
        other = np.r_[False, hash_[1:] != hash_[:-1]][: len(at)]
        # delisted by what the row says, or since it goes on with a delisted state (which ends a chain if listings revive)
        says = pc.fill_null(pc.equal(rows["availability"], "DELISTED"), False).to_numpy()
        goes_on = lasts & ~other & (not self.revive)
        marks = np.cumsum(says | (goes_on & silent))
        chain = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(at)))) if len(at) else np.arange(0)
        delisted = marks - marks[chain] + says[chain] > 0
        was = np.r_[False, delisted[:-1]][: len(at)] & follows
        back = np.arange(len(at)) - 1
        silenced = np.flatnonzero(silent & ~was)
        created = np.flatnonzero(fresh & ~lasts)
        changed = np.flatnonzero(lasts & (other | ((was | silent) & self.revive)))
        last = np.flatnonzero(np.r_[~follows[1:], True][: len(at)])
        ended = last[~delisted[last] & (now > at[last] + self.silent)]
        delisted[ended] = True
        out = [(rows.take(i), at[i] + late, change) for i, late, change in ((back[silenced], self.silent, "delisted"), (ended, self.silent, "delisted"), (created, 0, "created"), (changed, 0, "changed"))]
        if self.forget is not None:
            last = last[now <= at[last] + self.silent + self.forget]
        known, delisted = rows.take(last), delisted[last]
        state = pc.if_else(pa.array(delisted), "DELISTED", known["availability"])
        return known.set_column(ROW.get_field_index("availability"), "availability", state), delisted, out

    def _wake(self, at: int, none_set: bool) -> None:
        before = None if none_set or not self.alarm.exists() else self.alarm.get()[0]
        if before is not None and before <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def close(self) -> None:
        pass


def _emitted(parts: list[tuple[pa.Table, np.ndarray, str]]) -> pd.DataFrame:
    """Rows with the times and changes that they are emitted with."""
    out = pa.concat_tables([rows.select(["source_id", "source_external_id", "price", "availability"]) for rows, _, _ in parts]).to_pandas()
    out["at"] = np.concatenate([at for _, at, _ in parts])
    out["change"] = np.repeat([change for _, _, change in parts], [rows.num_rows for rows, _, _ in parts]).astype(object)
    out.loc[out["change"] == "delisted", "availability"] = "DELISTED"
    return out[[x.split()[0] for x in EMITTED.split(", ")]]


def _in_rocksdb(spark: SparkSession) -> None:
    """Keyed state of any size is held on disk by the executors and checkpointed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def change_stream(observed_stream: DataFrame, delay: str = "1 hour", silent_minutes: int = 1440, forget_minutes: int | None = None, revive: bool = True, groups: int = 512) -> DataFrame:
    """Created and changed states of each listing, DELISTED after silence, and rows that fail.

    observed_stream: source_id, source_external_id, scraped_at, pos, hash, price, availability; with
    raw_title or observed_stock, blank titles and negative stock fail: they are emitted at once and
    change no state.  All other rows are emitted when the watermark has passed them; rows without a time
    have no place among them and are left out.  A silence ends when the listing is seen again: that is a change, or with revive=False one
    only if the state differs from the last (the listing stays delisted otherwise).  forget_minutes
    after a delisting its state is dropped, so that state follows live listings; a return is then new.

    State is held by group, a hash of the listing: a batch reads and writes the groups that it touches or
    that are due whole, a group in a task's memory at a time.  groups can't change while a checkpoint lives.
    """
    _in_rocksdb(observed_stream.sparkSession)
    failed = F.lit(False)
    if "raw_title" in observed_stream.columns:
        failed = failed | (F.trim(F.coalesce("raw_title", F.lit(""))) == "")
    if "observed_stock" in observed_stream.columns:
        failed = failed | F.coalesce(F.col("observed_stock") < 0, F.lit(False))
    numbered = dict(observed_stream.dtypes)["pos"] in ("tinyint", "smallint", "int", "bigint")
    rows = observed_stream.where("scraped_at is not null").withWatermark("scraped_at", delay).select(
        F.pmod(F.xxhash64("source_id", "source_external_id"), F.lit(groups)).cast("int").alias("part"),
        F.col("source_id").cast("string").alias("source_id"),
        F.col("source_external_id").cast("string").alias("source_external_id"),
        "scraped_at",
        F.unix_micros("scraped_at").alias("at"),
        (F.format_string("%020d", "pos") if numbered else F.col("pos").cast("string")).alias("pos"),
        "hash",
        F.col("price").cast("string").alias("price"),
        "availability",
        failed.alias("failed"),
    )
    states = ListingStates(silent_minutes * 60_000_000, None if forget_minutes is None else forget_minutes * 60_000_000, revive)
    found = rows.groupBy("part").transformWithStateInPandas(states, EMITTED, "Append", "EventTime")
    return found.select("source_id", "source_external_id", F.timestamp_micros("at").alias("scraped_at"), "change", F.col("price").cast(MONEY).alias("price"), "availability")


class LastSighting(StatefulProcessor):
    """Lets a row pass if its key was not seen for a while."""

    def __init__(self, gap: int, columns: list[str]):
        self.gap, self.columns = gap, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("sighted_micros", kind="stable")
        seen = self.seen.get()[0] if self.seen.exists() else None
        last, keep = seen, []
        for at in new["sighted_micros"]:
            keep.append(last is None or at > last + self.gap)
            last = at if last is None else max(last, at)
        if last != seen:
            if seen is not None:
                self.handle.deleteTimer((seen + self.gap) // 1000 + 1)
            self.seen.update((int(last),))
            self.handle.registerTimer((int(last) + self.gap) // 1000 + 1)
        if any(keep):
            yield new.loc[np.array(keep), self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(raw_stream: DataFrame, keys: list[str], at: str = "scraped_at", delay: str = "1 hour") -> DataFrame:
    """raw_stream without the rows whose keys were seen within delay before, by event time.

    Rows of one batch and of several are told apart alike; rows without a time are left out; a key's state is dropped when the watermark
    has passed its last sighting by delay.
    """
    _in_rocksdb(raw_stream.sparkSession)
    kinds = {f.name: f.dataType for f in raw_stream.schema}
    spark = raw_stream.sparkSession
    gap = int(spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {delay})")).first()[0])
    rest = [c for c in raw_stream.columns if c not in keys]
    kept = StructType([StructField(c, kinds[c]) for c in raw_stream.columns])
    timed = raw_stream.where(F.col(at).isNotNull()).withWatermark(at, delay).withColumn("sighted_micros", F.unix_micros(at))
    found = timed.groupBy(*keys).transformWithStateInPandas(LastSighting(gap, [*keys, *rest]), StructType([kept[c] for c in (*keys, *rest)]), "Append", "EventTime")
    return found.select(*raw_stream.columns)


def run_counters_stream(events: DataFrame, at: str, by: list[str], size: str = "5 minutes", slide: str | None = None, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling, sliding or (gap) session window."""
    window = F.session_window(at, gap) if gap else F.window(at, size, slide)
    return events.withWatermark(at, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rows")
