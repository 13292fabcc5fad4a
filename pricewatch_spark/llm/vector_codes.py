"""Vector code compression: product codes of integer vectors, assigned by LAESA pivots.

Components become integers floor(1024 * x), vectors are cut into PARTS equal consecutive parts, and
each part position has a codebook of at most ENTRIES entries.  Of the starting codebook PIVOTS
entries far from each other become the position's pivots; the distances of every part to them are
computed once and kept in a table beside the parts.  They never change, though the codebooks do: in
a round the distances of the entries to the same pivots are computed anew (256 x 8 numbers), and the
triangle inequality bounds a part's distance to an entry from below by the largest difference of
their distances to a pivot.  Entries are taken in the order of that bound, in waves of growing
size; a wave leaves out what the best distance so far rules out, and evaluates the rest exactly in
integers.  Bounds are held a little low (SLACK), so rounding rules out nothing that could win or tie.

A round is one pass over the written table: tasks assign their parts and emit a row an entry with
count and sums, Spark adds these up, and the codebooks (ENTRIES x dimension integers, whatever the
input) are all that the driver holds and sends out.

Defined results: rows whose vector is null or holds null or non-finite components are left out; a
null vec_id is coded like others but starts no codebook entry; of repeated vec_ids each row counts,
entries start from them in the order of their components; shorter vectors, and lengths that are no
multiple of PARTS, count as padded with zeros to the longest kept one (an empty vector is all
zeros); fewer than ENTRIES vectors give as many entries, none (an empty table) gives no rows; equal
labels share one label_error, null labels another; components beyond 2**60 count as 2**60, sums of
errors beyond a long as the largest long; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, table

NAME = "op13_vector_codes"
ORACLE_SQL = None
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Pivots a part position.
PIVOTS = 8
#: Ends of the waves in which entries are evaluated, by their bounds.
WAVES = (1, 4, 16, 64)
#: Share of the distances by which single-precision bounds are lowered.
SLACK = 1e-5
LARGEST = 2**60
LONG = 2**63 - 1


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component."""
    held = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x.cast("double") * SCALE).cast("double")))
    whole = lambda x: F.when(F.abs(x) < float(LARGEST // SCALE), F.floor(x.cast("double") * SCALE).cast("long")).otherwise(held(x).cast("long"))
    return F.transform(vector, whole)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; arrays of Python integers stay such."""
    d = x - y
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def exact(x: np.ndarray) -> np.ndarray:
    """x in the narrowest integers that hold all sums of squared differences, Python's at last."""
    largest, width = np.abs(x).max(initial=0), max(1, x.shape[-1])
    for kind in (np.int32, np.int64):
        if 4 * int(largest) ** 2 * width < np.iinfo(kind).max:
            return x.astype(kind, copy=False)
    return x.astype(object)


def roots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x to each of y."""
    return np.stack([np.sqrt(squared(x, e).astype(np.float64)) for e in y], axis=1) if len(y) else np.zeros((len(x), 0))


def pivots(book: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries of a starting codebook, each the farthest from those before."""
    book = exact(book)
    chosen = [0]
    nearest = squared(book, book[0]).astype(np.float64)
    while len(chosen) < min(count, len(book)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(book, book[chosen[-1]]).astype(np.float64))
    return book[chosen]


def assign(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, of_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (ties: the lower index), its squared distance, and how many
    distances were evaluated.

    to_pivots: a part's distances to the pivots; of_entries: the entries' own.
    """
    n, k = len(parts), len(book)
    bound = np.zeros((n, k), np.float32)
    for p in range(of_entries.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p : p + 1] - of_entries[:, p].astype(np.float32)), out=bound)
    slack = SLACK * (to_pivots.max(axis=1, initial=0) + of_entries.max(initial=0)) + SLACK
    bound = np.maximum(bound - slack[:, None].astype(np.float32), 0)
    ends = [e for e in WAVES if e < k]
    order = np.argpartition(bound, [e - 1 for e in ends] + [k - 1], axis=1)
    both = exact(np.concatenate([parts, book]))
    x, entries = both[:n], both[n:]
    kind = x.dtype
    best, found, evaluated = np.full(n, -1, kind), np.full(n, -1, np.int64), 0
    reach = np.full(n, np.inf)
    for start, end in zip([0, *ends], [*ends, k], strict=True):
        places = order[:, start:end]
        row, at = np.nonzero(np.take_along_axis(bound, places, axis=1) <= reach[:, None])
        if not len(row):
            continue
        entry = places[row, at]
        distance = squared(x[row], entries[entry])
        evaluated += len(row)
        first = np.flatnonzero(np.diff(row, prepend=-1))  # np.nonzero goes by row
        sizes = np.diff(np.append(first, len(row)))
        r, d = row[first], np.minimum.reduceat(distance, first)
        e = np.minimum.reduceat(np.where(distance == np.repeat(d, sizes), entry, k), first)
        better = (found[r] < 0) | (d < best[r]) | ((d == best[r]) & (e < found[r]))
        best[r[better]], found[r[better]] = d[better], e[better]
        reach[r] = np.sqrt(best[r].astype(np.float64)) * (1 + 1e-9)
    return found, best, evaluated


def _matrix(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(kind, copy=False)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Codebooks:
    """The codebooks of all part positions with what does not change: the pivots."""

    def __init__(self, books: list[np.ndarray], fixed: list[np.ndarray]):
        self.books, self.fixed = books, fixed
        self.width = books[0].shape[1]
        self.to_pivots = [roots(exact(np.concatenate([b, p]))[: len(b)], p) for b, p in zip(books, fixed, strict=True)]

    def codes(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By part position: the parts, their entries and squared distances."""
        parts, known = _matrix(batch, "parts", np.int64), _matrix(batch, "to_pivots", np.float32)
        count = known.shape[1] // PARTS
        for k, (book, own) in enumerate(zip(self.books, self.to_pivots, strict=True)):
            mine = parts[:, k * self.width : (k + 1) * self.width]
            found, distance, _ = assign(mine, known[:, k * count : (k + 1) * count], book, own)
            yield mine, found, distance

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def with_pivot_distances(rows: DataFrame, fixed: list[np.ndarray]) -> DataFrame:
    """rows (vec_id, label, parts) with to_pivots: the distances of each part to its position's pivots."""
    width = fixed[0].shape[1]

    def run(batches):
        for batch in _slices(batches):
            parts = _matrix(batch, "parts", np.int64)
            own = [roots(exact(np.concatenate([parts[:, k * width : (k + 1) * width], p.astype(np.int64)]))[: len(parts)], p) for k, p in enumerate(fixed)]
            flat = np.concatenate(own, axis=1).astype(np.float32)
            ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], names=[*batch.schema.names, "to_pivots"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", to_pivots array<float>")


def sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n, s0, s1, ...: how many parts each entry got, and their componentwise sums."""

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        totals = [np.zeros(b.shape, object) for b in books.books]
        for batch in _slices(batches):
            for k, (parts, found, _) in enumerate(books.codes(batch)):
                order = np.argsort(found, kind="stable")
                entries, starts, sizes = np.unique(found[order], return_index=True, return_counts=True)
                counts[k][entries] += sizes
                mine = parts if np.abs(parts).max(initial=0) < LARGEST >> 20 else parts.astype(object)
                totals[k][entries] += np.add.reduceat(mine[order], starts, axis=0).astype(object)
        rows_ = [(k, e, int(counts[k][e]), [str(x) for x in totals[k][e]]) for k in range(len(counts)) for e in np.flatnonzero(counts[k])]
        names = ("part", "entry", "n", "total")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], kind) for i, kind in enumerate(kinds)], names=names)

    found = rows.mapInArrow(run, "part int, entry int, n long, total array<string>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each)


def renewed(books: Codebooks, rows: DataFrame) -> Codebooks:
    """One round: entries become the floor of their parts' mean; those without parts stay."""
    new = [b.copy() for b in books.books]
    for r in sums(rows, books).collect():  # PARTS * ENTRIES rows at most
        new[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(books.width)]
    return Codebooks(new, books.fixed)


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error."""

    def run(batches):
        for batch in _slices(batches):
            codes, error = [], np.zeros(batch.num_rows, object)
            for _, found, distance in books.codes(batch):
                codes.append(found)
                error += distance.astype(object)
            names = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array([min(int(x), LONG) for x in error], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(coded: DataFrame, hot: int = 1000) -> DataFrame:
    """coded with label_error.  Labels that hold more than one row in hot (so fewer than hot of them)
    are joined by broadcast, all others by a shuffle; nulls are a label."""
    total = coded.count()
    sums_ = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums_ = sums_.select(F.col("label").alias("l"), "n", F.least("s", F.lit(LONG)).cast("long").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("l"))
    common = coded.join(F.broadcast(sums_.where(F.col("n") * hot > total)), same, "left")
    rare = common.where("n is null").drop("l", "n", "label_error").join(sums_.where(F.col("n") * hot <= total), same)
    return common.where("n is not null").unionByName(rare).drop("l", "n")


def vector_codes(spark: SparkSession, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors (vec_id, a vector, label) -> vec_id, label, code, error, label_error, codebooks_sha256."""
    scratch = Scratch(spark, "vector-codes")
    kept = vectors.where(finite(F.col(column))).select("vec_id", "label", integers(F.col(column)).alias("parts"))
    longest = kept.agg(F.max(F.size("parts"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, label {dict(vectors.dtypes)['label']}, code string, error long, label_error long, codebooks_sha256 string")
    length = max(PARTS, -(-longest // PARTS) * PARTS)
    padded = F.when(F.size("parts") < length, F.concat("parts", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("parts")))).otherwise(F.col("parts"))
    kept = kept.withColumn("parts", padded)
    start = [r["parts"] for r in kept.where("vec_id is not null").orderBy("vec_id", "parts").limit(ENTRIES).collect()]
    if not start:  # no row has an id: the least vectors
        start = [r["parts"] for r in kept.orderBy("parts").limit(ENTRIES).collect()]
    width = length // PARTS
    start = np.array(start, np.int64)
    books = [start[:, k * width : (k + 1) * width] for k in range(PARTS)]
    fixed = [pivots(b) for b in books]
    rows = scratch.write(with_pivot_distances(kept, fixed), "parts")
    books = Codebooks(books, fixed)
    for _ in range(ROUNDS):
        books = renewed(books, rows)
    coded = scratch.write(encoded(rows, books), "coded")
    scratch.clear("coded")
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books.digest()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark, table(spark, sf_dir, "embeddings"))
