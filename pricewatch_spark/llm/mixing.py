"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document falls into one of its source's blocks by a hash of its id and text, and a source's
blocks have a permuted order.  A source whose target is r times its size passes floor(r) times
over all of its blocks and once more over as many as its target asks for; of the last block of
that pass documents are taken in a permuted order, as long as they fit.  A lot is one block in one
pass, and a source's quota is its number of lots.  A binary tree deals the quotas to the output
shards: at each node the lots that go left follow the multivariate hypergeometric law, given how
many lots each side takes.  Each shard then draws as many of the source's next lots as the tree
gave it, so that shards draw disjoint lots; a lot that no shard draws is not in the mix.  A shard
orders its documents by a hash, its local shuffle.

Defined results: null and empty texts have size 0 and are dealt like others; a null source is a
source of its own, the last; without words a source has target 0; documents with a null id are
documents like others; repeated rows are rows of their own and get the same decision; very long
texts count whole, and one that doesn't fit any more gives way to smaller ones; ties in an order
go by block or id; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, raw_bytes, table, word_spans

NAME = "op7_mixing"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
DOCS_A_BLOCK = 512
SHARDS = 64
SOURCES_BROADCAST = 100_000
SEGMENTS = 256  # of a source's permuted order; sums run over these, then within each
SEED = 17
ORACLE_SQL = None


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size (its number of words), pick (a hash of id and text)."""

    def count(batches):
        for batch in batches:
            sizes = [len(word_spans(raw_bytes(x.as_py()))[0]) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "pick")), pa.array(sizes, pa.int64())], names=["doc_id", "source", "pick", "size"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("pick", F.xxhash64(F.lit(seed), "doc_id", "text")).mapInArrow(count, f"doc_id {kind}, source string, pick long, size long")


def targets(sizes: dict[str | None, int], share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> dict[str | None, float]:
    """Each source's words: shares by weight, capped at most times its size, the excess reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left, all_weights = total - sum(out.values()), sum(weight[s] for s in names if s in free)
        over = [s for s in names if s in free and left * weight[s] / all_weights > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / all_weights for s in names if s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= set(over)
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas: blocks by source -> shards x sources, blocks of each source in each shard."""
    generator = np.random.default_rng(seed)

    def split(left_of: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [left_of]
        half = n // 2
        take = int(left_of.sum()) * half // n
        left = generator.multivariate_hypergeometric(left_of, take, method="marginals") if left_of.sum() else left_of.copy()
        return split(left, half) + split(left_of - left, n - half)

    return np.stack(split(np.asarray(quotas, np.int64), shards))


def by_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row a source, to be joined on in_source; broadcast if it has few rows."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= SOURCES_BROADCAST else out


def same_source(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Join on source (null is a source) and the keys; other has in_source for source."""
    on = F.col("source").eqNullSafe(F.col("in_source"))
    for k in keys:
        other = other.withColumnRenamed(k, f"in_{k}")
        on = on & (F.col(k) == F.col(f"in_{k}"))
    return df.join(other, on).drop("in_source", *(f"in_{k}" for k in keys))


def ordered(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks (source, block, words) with place and before: how many blocks and words precede it in its
    source's permuted order.  Sums run over segments of the order first, so no task gets a whole source."""
    h = F.xxhash64(F.lit(seed + 1), "block")
    rows = blocks.withColumn("h", h).withColumn("segment", F.pmod("h", F.lit(SEGMENTS)))
    earlier = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = rows.groupBy("source", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    starts = starts.select(F.col("source").alias("in_source"), "segment", F.coalesce(F.sum("n").over(earlier), none).alias("n0"), F.coalesce(F.sum("w").over(earlier), none).alias("w0"))
    inside = Window.partitionBy("source", "segment").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("n1", F.coalesce(F.count(F.lit(1)).over(inside), none)).withColumn("w1", F.coalesce(F.sum("words").over(inside), none))
    return same_source(counted, starts, "segment").withColumn("place", F.col("n0") + F.col("n1")).withColumn("before", F.col("w0") + F.col("w1")).drop("h", "segment", "n0", "n1", "w0", "w1")


def fitting(docs: DataFrame) -> DataFrame:
    """Of blocks that are taken in part (source, block, pick, size, room): in_source, block, pick of
    the documents taken, in the order of picks as long as they fit, and the one that comes nearest."""
    # rows that share a pick are equal and are decided together
    rows = docs.groupBy("source", "block", "pick", "room").agg(F.sum("size").alias("size"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pick", kind="stable")
        left, taken = float(part["room"].iloc[0]), []
        for size in part["size"]:
            taken.append(size <= left)
            left -= size if taken[-1] else 0
        rest = np.where(taken, np.inf, part["size"].to_numpy(float))
        if len(rest) and rest.min() < 2 * left:
            taken[int(rest.argmin())] = True
        return part.loc[taken, ["source", "block", "pick"]].rename(columns={"source": "in_source"})

    return rows.groupBy("source", "block").applyInPandas(choose, "in_source string, block long, pick long")


def drawn_lots(spark: SparkSession, quotas: dict[str | None, int], shards: int, seed: int) -> DataFrame:
    """in_source, upto: how many of the source's lots the shards up to each one draw, as the tree deals them."""
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    ends = np.cumsum(splitting_tree(np.array([quotas[s] for s in names], np.int64), shards, seed), axis=0) if names else np.zeros((shards, 0))
    return by_source(spark, [(s, [int(x) for x in ends[:, j]]) for j, s in enumerate(names)], "in_source string, upto array<long>")


def mix(spark: SparkSession, docs: DataFrame, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, drawn, taken.

    drawn has an entry for each copy of the document in the mix: its copy, the shard that draws it
    and its place in the shard's local shuffle; taken is the words of these copies.
    """
    scratch = Scratch(spark, "mixing")
    base = scratch.write(sized(docs, seed), "sizes")
    found = base.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # a row a source
    sizes, rows = {r["source"]: r["s"] for r in found}, {r["source"]: r["n"] for r in found}
    want = targets(sizes, share)
    facts = []
    for s in sizes:
        passes = math.floor(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
        facts.append((s, sizes[s], float(want[s]), passes, max(0.0, want[s] - passes * sizes[s]), max(1, -(-rows[s] // DOCS_A_BLOCK))))
    facts = by_source(spark, facts, "in_source string, source_size long, target double, passes int, rest double, blocks long")
    placed = same_source(base, facts).withColumn("block", F.pmod("pick", F.col("blocks")))
    blocks = ordered(placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes")), seed)
    # the last pass takes the blocks that begin before its words are reached, the last of them in part
    blocks = scratch.write(blocks.withColumn("more", F.col("before") < F.col("rest")).withColumn("part", F.expr("more and before + words > rest")), "blocks")
    counts = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.first("passes").alias("p"), F.sum(F.col("more").cast("long")).alias("k")).collect()  # a row a source
    n_blocks = by_source(spark, [(r["source"], r["n"]) for r in counts], "in_source string, n_blocks long")
    upto = drawn_lots(spark, {r["source"]: r["p"] * r["n"] + r["k"] for r in counts}, shards, seed)
    # lots are numbered pass by pass; a shard draws the next ones of its share
    shard = lambda lot: F.size(F.filter("upto", lambda x: x <= lot))
    lots = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda c: F.struct(c.alias("copy"), shard(c * F.col("n_blocks") + F.col("place")).alias("shard")))
    lots = F.filter(F.slice(lots, F.lit(1), F.col("passes") + F.col("more").cast("int")), lambda x: x["shard"] < shards)
    dealt = same_source(same_source(blocks, n_blocks), upto).select(F.col("source").alias("in_source"), "block", lots.alias("lots"), "part", (F.col("rest") - F.col("before")).alias("room"))
    joined = same_source(placed, scratch.write(dealt, "dealt"), "block")
    fits = scratch.write(fitting(joined.where("part").select("source", "block", "pick", "size", "room")), "fitting")
    part = joined.where("part").join(
        fits.select(F.col("pick").alias("p"), F.col("block").alias("b"), "in_source", F.lit(True).alias("fits")),
        F.col("source").eqNullSafe(F.col("in_source")) & (F.col("block") == F.col("b")) & (F.col("pick") == F.col("p")),
        "left",
    )
    part = part.withColumn("lots", F.filter("lots", lambda x: (x["copy"] < F.col("passes")) | F.coalesce(F.col("fits"), F.lit(False))))
    columns = ["doc_id", "source", "size", "source_size", "target", "pick", "lots"]
    place = lambda x: F.xxhash64(F.lit(seed + 2), "pick", x["copy"])
    drawn = F.transform("lots", lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), place(x).alias("place")))
    mixed = joined.where("not part").select(columns).unionByName(part.select(columns)).withColumn("drawn", drawn)
    return mixed.select(*columns[:5], "pick", "drawn", (F.col("size") * F.size("drawn")).cast("long").alias("taken"))


def with_texts(mixed: DataFrame, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """mixed (of docs and seed) with text, and in others all further columns of docs as a struct.

    Rows that share a pick and a source are equal in id and text and have one decision.
    """
    columns = ["doc_id", "size", "source_size", "target", "drawn", "taken"]
    decided = mixed.groupBy(F.col("source").alias("in_source"), F.col("pick").alias("in_pick")).agg(F.first(F.struct(*columns)).alias("m"))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("source").cast("string").alias("source"), text.alias("text"), F.xxhash64(F.lit(seed), "doc_id", text).alias("pick"), others.alias("others"))
    found = rows.join(decided, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("pick") == F.col("in_pick")))
    return found.select("m.doc_id", "source", "m.size", "m.source_size", "m.target", "pick", "m.drawn", "m.taken", "text", "others")


def shard_rows(mixed: DataFrame) -> DataFrame:
    """shard, place, copy and all columns of mixed but drawn: a row for each copy that a shard draws."""
    return mixed.withColumn("x", F.explode("drawn")).select("x.shard", "x.place", "x.copy", *(c for c in mixed.columns if c != "drawn"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Each shard's rows in a folder of its own, in the order of place."""
    rows = shard_rows(mixed)
    rows.repartition("shard").sortWithinPartitions("shard", "place", "pick").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("drawn.shard").alias("shards"), F.col("drawn.place").alias("places"))
