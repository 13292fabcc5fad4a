"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each place, the sum of its code points times the powers of a base,
modulo a prime; two primes of 31 bits give 62 bits a span.  The hash of any span is a difference of
two entries brought back to place 0 by an inverse power, so the equality of any two spans, of one
text or of two, is one comparison, and the longest common extension of two places (how far the texts
agree from there) is found by binary search.  Arrays of many texts are built as one.

A fingerprint keeps of its text the length, the hash of the whole, and the hashes of its prefixes
and suffixes at places that are the same for all texts (GRID: the first eight, then eight an octave),
so it grows with the logarithm of the length.  From two fingerprints the common prefix and suffix
follow by binary search, down to the last place of the grid; their likeness is the share of the
longer text that these cover, 1 for equal texts.

Neighbours in descending doc_id meet without one task holding all: rows are dealt by ranges of
(doc_id, hash of text) whose bounds are rows of the table, and a range's first row also goes to the
range before it, as its last neighbour.  Texts are shuffled once.

Defined results: a null text is an empty one (n_chars 0, likeness 1 to an empty text, 0 to others);
null doc_ids come last in the order; repeated doc_ids follow each other by the hash of their texts,
repeated rows are each other's neighbours (rows that agree in doc_id and text meet in one task, which
reads them one by one); a table of one row is its own neighbour; very long texts are read whole; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import table, texts

NAME = "op11_prefix_fingerprints"
ORACLE_SQL = None
#: Primes and bases of the two hashes.
PRIMES = (2147483647, 2147483629)
BASES = (1540483477, 1190494759)
#: Places of the grid an octave, and the first ones, which are all kept.
OCTAVE, FIRST = 8, 8
#: Code points whose arrays are built at once (a longer text alone).
AT_ONCE = 1 << 19
#: A range of neighbours takes about so many bytes; there are so many ranges at most.
RANGE_BYTES, RANGES = 64 << 20, 100_000
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def grid(longest: int) -> np.ndarray:
    """The places below longest."""
    octaves = max(1, int(longest).bit_length())
    steps = FIRST * 2.0 ** (np.arange(1, OCTAVE * octaves) / OCTAVE)
    places = np.concatenate([np.arange(1, FIRST + 1), np.floor(steps).astype(np.int64)])
    return np.unique(places[places < longest])


_GRID = grid(1 << 40)


def _power_table(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime, for i < n at least."""
    known = _powers.get(which)
    if known is None or len(known[0]) < n:
        size, p = 1 << max(16, int(n).bit_length()), PRIMES[which]
        both = []
        for base in (BASES[which], pow(BASES[which], -1, p)):
            powers = np.ones(size, np.uint64)
            done = 1
            while done < size:
                powers[done : 2 * done] = powers[:done] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done *= 2
            both.append(powers)
        known = _powers[which] = (both[0], both[1])
    return known


class PrefixHashes:
    """The prefix arrays of texts, one after the other."""

    def __init__(self, all_texts: list[str]):
        codes = np.frombuffer("".join(all_texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sizes = np.array([len(t) for t in all_texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        self.sums, self.inverse = [], []
        for which, p in enumerate(PRIMES):
            up, down = _power_table(len(codes) + 1, which)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * up[: len(codes)] % np.uint64(p), out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(down)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The 62-bit hashes of spans, given by places in all texts together."""
        out = np.zeros(len(start), np.uint64)
        for p, sums, inverse in zip(PRIMES, self.sums, self.inverse, strict=True):
            out = (out << np.uint64(31)) | ((sums[end] - sums[start]) % np.uint64(p) * inverse[start] % np.uint64(p))
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of length from a and from b are equal."""
        return self.spans(a, a + length) == self.spans(b, b + length)

    def extensions(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extension of each a and b, most at the longest, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def fingerprints(self) -> list[Fingerprint]:
        """Of each text."""
        counts = np.searchsorted(_GRID, self.sizes)  # places below the length
        of = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        place = _GRID[np.arange(len(of)) - np.repeat(ends - counts, counts)]
        first, last = self.starts[of], (self.starts + self.sizes)[of]
        low = np.uint64(0xFFFFFFFF)
        prefixes = (self.spans(first, first + place) & low).astype("<u4")
        suffixes = (self.spans(last - place, last) & low).astype("<u4")
        whole = self.spans(self.starts, self.starts + self.sizes).tolist()
        return [Fingerprint(n, h, prefixes[e - c : e].tobytes(), suffixes[e - c : e].tobytes()) for n, h, c, e in zip(self.sizes.tolist(), whole, counts.tolist(), ends.tolist(), strict=True)]


class Fingerprint(NamedTuple):
    """Length, hash of the whole, and 32 bits of the hash of each prefix and suffix of the grid."""

    n: int
    whole: int
    prefixes: bytes
    suffixes: bytes

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole:016x}.{base64.b64encode(self.prefixes + self.suffixes).decode()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, rest = text.split(".")
        both = base64.b64decode(rest)
        return cls(int(n, 16), int(whole, 16), both[: len(both) // 2], both[len(both) // 2 :])


def _agree(a: bytes, b: bytes) -> int:
    """The last place of the grid up to which two texts agree (0: none), by binary search."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        middle = (low + high + 1) // 2
        at = slice(4 * middle - 4, 4 * middle)
        low, high = (middle, high) if a[at] == b[at] else (low, middle - 1)
    return int(_GRID[low - 1]) if low else 0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The share of the longer text that the common prefix and suffix cover."""
    if a[:2] == b[:2]:
        return 1.0
    both = _agree(a.prefixes, b.prefixes) + _agree(a.suffixes, b.suffixes)
    return min(both, a.n, b.n) / max(a.n, b.n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            ids, words = batch.column("doc_id"), batch.column("text").to_pylist()
            at = 0
            for group in _groups(words, len):
                found = PrefixHashes(group).fingerprints()
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), pa.array([f.n for f in found], pa.int64()), pa.array([str(f) for f in found])], names=["doc_id", "n_chars", "fingerprint"])
                at += len(group)

    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def common_extensions(pairs: DataFrame) -> DataFrame:
    """pairs (text_a, at_a, text_b, at_b and others) with extension: from how many code points on, from
    place at_a of one text and at_b of the other, the texts agree.  A place outside of its text, or a
    null, gives 0.  Spans of length L from there are equal if extension >= L."""

    def run(batches):
        for batch in batches:
            a, b = ([x or "" for x in batch.column(c).to_pylist()] for c in ("text_a", "text_b"))
            i, j = ([x if x is not None else -1 for x in batch.column(c).to_pylist()] for c in ("at_a", "at_b"))
            out, at = [], 0
            for group in _groups(list(zip(a, b, strict=True)), lambda x: len(x[0]) + len(x[1])):
                arrays = PrefixHashes([t for pair in group for t in pair])
                n = len(group)
                places = [np.array(x[at : at + n], np.int64) for x in (i, j)]
                rest = [np.where(p < 0, 0, s - p) for p, s in zip(places, (arrays.sizes[::2], arrays.sizes[1::2]), strict=True)]
                most = np.maximum(0, np.minimum(*rest))
                starts = [np.where(most > 0, s + p, 0) for s, p in zip((arrays.starts[::2], arrays.starts[1::2]), places, strict=True)]
                out.append(arrays.extensions(*starts, most))
                at += n
            found = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "extension"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in pairs.columns) + ", extension long")


def _groups(rows: list, size) -> Iterator[list]:
    """Runs of rows of AT_ONCE code points at most, or of one row."""
    group, held = [], 0
    for row in rows:
        if group and held + size(row) > AT_ONCE:
            yield group
            group, held = [], 0
        group.append(row)
        held += size(row)
    if group:
        yield group


# --- neighbours ----------------------------------------------------------------------------------


def _in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, down, text_hash, range, tail: rows by ranges of descending doc_id; a tail is a copy
    of the next range's first row."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumns({"down": F.bitwise_not("doc_id"), "text_hash": F.unhex(F.md5(F.col("text").cast("binary")))})
    order = [F.col("down").asc_nulls_last(), F.col("text_hash").asc()]
    keys = rows.select("down", "text_hash", F.octet_length("text").alias("size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = min(RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES))
    key = F.struct(F.col("down").isNull().alias("none"), F.coalesce("down", F.lit(0).cast("long")).alias("down"), "text_hash")
    # any rows of the table serve as bounds, so it does not matter how the sample for the ranges fell
    parts = keys.repartitionByRange(wanted, *order).select(F.spark_partition_id().alias("part"), key.alias("key"))
    heads = sorted((r["k"]["none"], r["k"]["down"], bytes(r["k"]["text_hash"])) for r in parts.groupBy("part").agg(F.min("key").alias("k")).collect())  # a row a range
    shared = spark.sparkContext.broadcast(heads)

    def deal(batches):
        bounds = shared.value
        first = set(bounds)
        for batch in batches:
            own = [(d is None, d or 0, h) for d, h in zip(batch.column("down").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)]
            at = [bisect_right(bounds, k) - 1 for k in own]
            tails = [k for k, x in enumerate(own) if x in first]
            for take, ranges, tail in ((None, at, False), (tails, [(at[k] - 1) % len(bounds) for k in tails], True)):
                part = batch if take is None else batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ranges, pa.int32()), pa.array([tail] * len(ranges), pa.bool_())], names=[*batch.schema.names, "range", "tail"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, down long, text_hash binary, range int, tail boolean")
    return dealt.repartition("range").sortWithinPartitions("range", "tail", *order)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    """Rows of the result for (doc_id, text, text of the next document)."""
    own, following = [p[1] for p in pairs], [p[2] for p in pairs]
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(own, following, strict=True)]
    # mostly the next document is the next pair's own; others follow at the end
    where, others = [], []
    for k, after in enumerate(following):
        if k + 1 < len(own) and own[k + 1] is after:
            where.append(k + 1)
        else:
            where.append(2 * len(own) + len(others))
            others.append(after)
    arrays = PrefixHashes(own + edited + others)
    found = arrays.fingerprints()
    n = len(own)
    a, b, c = found[:n], found[n : 2 * n], [found[k] for k in where]
    starts, sizes = arrays.starts, arrays.sizes
    common = lambda x: arrays.extensions(starts[:n], starts[x], np.minimum(sizes[:n], sizes[x]))
    columns = [
        pa.array([p[0] for p in pairs], pa.int64()),
        pa.array([f.n for f in a], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array([str(f) for f in a]),
        pa.array([str(f) for f in b]),
        pa.array([likeness(x, y) for x, y in zip(a, b, strict=True)], pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(a, c, strict=True)], pa.float64()),
        pa.array(common(np.arange(n, 2 * n)), pa.int64()),
        pa.array(common(np.array(where, np.int64)), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in COLUMNS.split(", ")])


def against_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text edited by the next document's, and how alike they
    and the next document's are; common_edited and common_next are the exact common prefixes."""

    def run(batches):
        def pairs():
            before = None
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "tail")), strict=True):
                    if before is not None and not before[3]:
                        yield (*before[:2], row[1])
                    before = row

        group, held = [], 0
        for pair in pairs():
            group.append(pair)
            held += 2 * len(pair[1])
            if held > AT_ONCE:
                yield _compared(group)
                group, held = [], 0
        if group:
            yield _compared(group)

    return _in_ranges(docs).select("doc_id", "text", "range", "tail").mapInArrow(run, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_neighbours(table(spark, sf_dir, "documents"))
