"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct word shingles (64-bit hashes).  Each shingle falls into one of
REGISTERS buckets; a bucket keeps, of the smallest value in it, the leading-zero count and ten
mantissa bits: 16 bits.  Empty buckets are filled from others chosen by fixed random tables.
BANDS bands of ROWS registers give the keys under which candidates meet.

Documents with equal sets form a class, which takes part once.  Members of a band bucket are
compared with its centre, the member that meets most others in all of its buckets: first by the
registers' estimate, corrected for chance collisions, then on the full sets.  Most links are found
so, and most buckets lie in one component then.  The members of all other buckets (the rest) are
looked at more closely, without comparing all pairs: a link of x and y needs a * (|x| + |y|) common
shingles (a = t / (1 + t), t the similarity), so if both order their shingles by how many of the
rest have them, rarest first, both hold one common shingle among the first
|x| - ceil(a * (|x| + |y|)) + 1 of x and as many of y.  These prefixes, cut to what the smallest
member of a group allows, make groups by shingle; a group that lies in one component is done.  Of
any other, members outside its largest component meet all its members of other components that
the bound allows (CENTRES of them in the first round, twice as many in each next one), until no
group has two components.  So every link between members of a common bucket is found or implied,
and copies, groups of near copies and texts that share common lines cost time in proportion.

A pair of similarity 0.8 shares no band with probability 6e-6 (0.85: 1e-8), and the estimate
misses it (cut at ESTIMATE_FLOOR, six deviations) with probability below 1e-8.

Defined results: null texts and texts without words have the empty set and are linked with
nothing, not even each other; a text shorter than a shingle is one shingle of its own kind; very
long texts are taken whole (a text's set is held in one task); every row is a document, repeated
rows and repeated or null doc_ids included, and a null doc_id never names a component in which
another id is; ties go to the smallest doc_id; an empty table gives no rows; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, as_long, fold_ascii, mix, raw_bytes, table, windows, word_hashes
from pricewatch_spark.llm.graph import components
from pricewatch_spark.llm.repeats import arrays, hashed

NAME = "op8_near_dedup"
REGISTERS = 240
ROWS = 6
BANDS = REGISTERS // ROWS
MANTISSA = 10
ESTIMATE_FLOOR = 0.64
_BITS = 48
#: Members of a group that meet all others in the first round of the rest; twice as many in the next, and so on.
CENTRES = 64
_TRIES = np.random.default_rng(11).integers(0, REGISTERS, (256, REGISTERS))
#: Two registers of unlike sets of equal size agree with about a third of 2**-MANTISSA.
CHANCE = 1 / 3 / 2**MANTISSA


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of the whole sequence if it is shorter."""
    hashes = word_hashes(fold_ascii(raw_bytes(text)))[0]
    if not len(hashes):
        return hashes
    if len(hashes) < words:  # its own kind, so that it can't equal a full shingle
        return mix(windows(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(windows(hashes, words))


def registers(found: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (uint16) of a non-empty set of hashes."""
    h = mix(found + np.uint64(0x632BE59BD9B4E019))
    bucket = ((h >> np.uint64(_BITS)) * np.uint64(REGISTERS)) >> np.uint64(64 - _BITS)
    order = np.sort((bucket << np.uint64(_BITS)) | (h & np.uint64((1 << _BITS) - 1)))
    at, first = np.unique(order >> np.uint64(_BITS), return_index=True)
    part, exponent = np.frexp((order[first] & np.uint64((1 << _BITS) - 1)).astype(np.float64))
    value = ((_BITS - exponent) << MANTISSA) | ((part * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)
    full = np.zeros(REGISTERS, bool)
    full[at.astype(np.int64)] = True
    out = np.zeros(REGISTERS, np.uint16)
    out[at.astype(np.int64)] = value
    empty = np.flatnonzero(~full)
    for tries in _TRIES:
        if not len(empty):
            return out
        source = tries[empty]
        out[empty] = np.where(full[source], out[source], 0)
        empty = empty[~full[source]]
    if len(empty):  # a set of very few: the next full bucket
        filled = at.astype(np.int64)
        out[empty] = out[filled[np.searchsorted(filled, empty) % len(filled)]]
    return out


def band_keys(of: np.ndarray) -> np.ndarray:
    rows = of.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key + rows[:, j])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, without the share of chance collisions."""
    return ((a == b).mean(axis=1) - CHANCE) / (1 - CHANCE)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a, set_b (128 bits naming the set), keys; a row a row of docs."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words)
                n.append(len(found))
                # the sum and the xor of two mixes name the set
                a.append(int(as_long(mix(found).sum(keepdims=True))[0]) if len(found) else None)
                b.append(int(as_long(np.bitwise_xor.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True))[0]) if len(found) else None)
                keys.append(as_long(band_keys(registers(found))) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "keys"],
            )

    return hashed(docs).mapInArrow(run, f"doc_id {kind}, text_hash binary, n_shingles long, set_a long, set_b long, keys array<long>")


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """id, n, registers, items (the set) of the classes in members (id, first: its row's doc_id and text_hash)."""

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column("text")]
            columns = [pa.array([registers(x).tobytes() for x in found], pa.binary()), pa.array([as_long(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in found], pa.int64()), *columns], names=["id", "n", "registers", "items"])

    named = members.select("id", F.col("first.text_hash").alias("text_hash"), F.col("first.nameless").alias("z"), F.col("first.doc_id").alias("d"))
    keys = ["text_hash", "z", "d"]
    no_id = F.lit(0).cast(dict(docs.dtypes)["doc_id"])
    named = named.withColumn("d", F.coalesce("d", no_id))
    own = hashed(docs).select("text_hash", F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", no_id).alias("d"), "text")
    return own.join(named, keys).dropDuplicates(keys).select("id", "text").mapInArrow(run, "id long, n long, registers binary, items array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (c, m) whose sets are so similar: by their registers, then exactly."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rc, rm = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("rc", "rm"))
            good = estimate(rc, rm) >= ESTIMATE_FLOOR
            left, right = arrays(batch.column("xc")), arrays(batch.column("xm"))
            for k in np.flatnonzero(good).tolist():
                c, m = left[k].view(np.uint64), right[k].view(np.uint64)  # in order, as shingles() gives them
                common = int((c[np.minimum(np.searchsorted(c, m), len(c) - 1)] == m).sum())
                good[k] = denominator * common >= numerator * (len(c) + len(m) - common)
            yield pa.RecordBatch.from_arrays([batch.column("c").filter(pa.array(good)), batch.column("m").filter(pa.array(good))], names=["c", "m"])

    left = sets.select(F.col("id").alias("c"), F.col("registers").alias("rc"), F.col("items").alias("xc"))
    right = sets.select(F.col("id").alias("m"), F.col("registers").alias("rm"), F.col("items").alias("xm"))
    return pairs.join(right, "m").join(left, "c").select("c", "m", "rc", "xc", "rm", "xm").mapInArrow(run, "c long, m long")


def _several(groups: DataFrame, key: str) -> DataFrame:
    """The rows of groups whose members lie in several components."""
    bounds = groups.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(key)
    return groups.join(bounds, key, "left_semi")


def _prefixes(sets: DataFrame, scratch: Scratch, numerator: int, denominator: int) -> DataFrame:
    """s, m, n, r: of each set those shingles that others have too and that a link could need to share, by rank."""
    flat = sets.select("id", "n", F.explode("items").alias("s"))
    counts = scratch.write(flat.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared")
    mine = flat.join(counts, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
    # all shingles of its own come first
    alone = F.col("n") - F.size("x")
    longest = F.expr(f"n - ({numerator} * n + {denominator - 1}) div {denominator} + 1")
    cut = mine.withColumn("alone", alone).withColumn("some", F.slice("x", F.lit(1), F.greatest(F.lit(0), longest - F.col("alone")).cast("int")))
    return cut.select(F.col("id").alias("m"), "n", "alone", F.posexplode("some").alias("p", "y")).select("y.s", "m", "n", (F.col("alone") + F.col("p")).alias("r"))


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, first: components of links of similarity
    numerator/denominator.  kept: doc_id names its component; first: of a component, the rows of the
    smallest doc_id and then text_hash."""
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select("doc_id", "text")
    whole = numerator + denominator
    shared = lambda a, b: f"(({numerator} * ({a} + {b}) + {whole - 1}) div {whole})"  # noqa: E731  the shingles that a link needs
    found = scratch.write(sketches(docs, words), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    classes = found.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(first).alias("first"), F.first("keys").alias("keys"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    banded = classes.select("id", F.explode("keys").alias("key"))
    buckets = scratch.write(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")  # so that Spark can split a large bucket
    members = scratch.write(banded.join(buckets, "key"), "members")
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    met = scratch.write(met, "met")
    centres = members.join(met, "id").groupBy("key").agg(F.max(F.struct("met", "id")).alias("c")).select("key", F.col("c.id").alias("c"))
    centres = scratch.write(centres, "centres")
    stars = scratch.write(members.join(centres, "key").where("id <> c").select("c", F.col("id").alias("m")).distinct(), "stars")
    sets = scratch.write(_sets(docs, classes.join(met, "id", "left_semi").select("id", "first"), words), "sets")
    links = scratch.write(_linked(stars, sets, numerator, denominator), "links")
    of = components(links.select(F.col("c").alias("a"), F.col("m").alias("b")), scratch, "components")

    with_component = lambda rows, key: rows.join(of.withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key))
    rest = _several(with_component(members.select("key", "id"), "id"), "key").select("id").distinct()
    rest = scratch.write(sets.join(rest, "id", "left_semi"), "rest")
    groups = with_component(_prefixes(rest, scratch, numerator, denominator), "m")
    for _ in range(2):  # what the smallest member of its group does not allow goes; then there may be another smallest
        low = groups.groupBy("s").agg(F.min("n").alias("low"))
        least = f"greatest(low, ({numerator} * n + {denominator - 1}) div {denominator})"
        groups = groups.join(low, "s").where(f"r <= n - {shared('n', least)}").drop("low")
    groups = scratch.write(groups, "groups")
    rows = scratch.write(_several(groups, "s"), "groups-0")
    for name in ("members", "buckets", "centres", "met", "stars", "groups"):
        scratch.drop(name)
    level, late = 0, []
    while not rows.isEmpty():
        sizes = rows.groupBy("s", "component").agg(F.count(F.lit(1)).alias("size"))
        largest = scratch.write(sizes.groupBy("s").agg(F.max(F.struct("size", "component")).alias("x")).select("s", F.col("x.component").alias("large")), f"largest-{level}")
        outside = rows.join(largest, "s").where("component <> large")
        heads = outside.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("m"))).where(F.col("k") <= CENTRES << level)
        heads = scratch.write(heads.select("s", F.col("m").alias("c"), F.col("n").alias("nc"), F.col("r").alias("rc"), F.col("component").alias("cc")), f"heads-{level}")
        meet = rows.join(heads, "s").where("component <> cc").where(f"r <= n - {shared('n', 'nc')} and rc <= nc - {shared('n', 'nc')}")
        pairs = meet.select(F.least("c", "m").alias("c"), F.greatest("c", "m").alias("m")).distinct()
        late.append(scratch.write(_linked(pairs, sets, numerator, denominator), f"links-{level}"))
        rows = rows.join(heads.select("s", F.col("c").alias("m")), ["s", "m"], "left_anti")
        level += 1
        rows = scratch.write(_several(rows, "s"), f"groups-{level}")
    late = reduce(DataFrame.unionByName, late) if late else links.limit(0)
    if not late.isEmpty():
        both = of.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late.select(F.col("c").alias("a"), F.col("m").alias("b")))
        of = components(both, scratch, "components-of-all")

    labels = with_component(classes.select("id", "set_a", "set_b", "first"), "id")
    names = scratch.write(labels.groupBy("component").agg(F.min("first").alias("of")), "names")
    labels = scratch.write(labels.join(names, "component").select("set_a", "set_b", "of"), "labels")
    scratch.clear("sketches", "labels")
    name = F.when(F.col("n_shingles") > 0, F.col("of.doc_id")).otherwise(F.col("doc_id"))
    return found.join(labels, ["set_a", "set_b"], "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        name.alias("component_id"),
        name.eqNullSafe(F.col("doc_id")).alias("kept"),
        (F.col("of").isNull() | (F.col("of.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("of.text_hash") == F.col("text_hash")))).alias("first"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=4).drop("text_hash", "first")


ORACLE_SQL = None
