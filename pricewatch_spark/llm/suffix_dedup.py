"""Suffix-array dedup: repeated byte strings from collection Burrows-Wheeler transforms.

The texts are cut into fragments: the windows of ``length`` bytes that share an anchor (see
repeats), with the bytes they reach over.  Only fragments whose anchor occurs at least twice
matter.  Equal fragments are counted as one with a weight.  All distinct fragments of an anchor
come together and are trimmed to what at least one other of them continues on either side; equal
pieces become one with a weight.  A task then builds the Burrows-Wheeler transform and the array
of longest common prefixes of its pieces column by column: every round inserts one symbol of each
piece, from the last to the first, and rewrites the transform and the prefixes from one
sequential external file to the next.  Runs of suffixes with common prefixes of at least
``length`` are the classes of equal windows; a class of weight two or more repeats.

A piece that is alone with its anchor needs no construction: two equal windows of one piece would
have one anchor at unequal places, so its windows repeat if and only if its weight is two or
more.  If an anchor has more than ``group`` distinct fragments they are salted and not trimmed;
their classes are counted over the salts by a 128-bit digest.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; a text with a
copy is removed whole if it is that long; repeated rows are documents of their own; null doc_ids
are kept; very long texts are taken whole; there are no ties, since every copy of a string goes; an
empty table gives no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import Scratch, raw_bytes, table
from pricewatch_spark.llm.repeats import alive, anchored, anchors, arrays, copied, covered_runs, hashed, runs, surviving, units, with_text

NAME = "op4_suffix_dedup"
LENGTH = 200
ANCHOR = 64
GROUP = 4096  # distinct fragments of an anchor that go into one construction
CHUNK = 1 << 18  # bytes of fragments before trimming in one construction, from which on it is closed
ORACLE_SQL = None


class ColumnFiles:
    """The growing transform with its prefixes, a sequential file rewritten into another each round.

    A row is a 32-bit number: the common prefix with the row before, then nine bits of symbol.
    """

    def __init__(self):
        self.old, self.new = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def write(self, rows: np.ndarray) -> None:
        self.new.seek(0)
        self.new.write(rows)
        self.new.truncate()
        self.old, self.new = self.new, self.old

    def read(self) -> np.ndarray:
        self.old.seek(0)
        return np.frombuffer(self.old.read(), np.uint32)

    def close(self) -> None:
        self.old.close()
        self.new.close()


_BITS = np.uint32(9)
_SYMBOL = np.uint32(511)


def by_symbol(symbols: np.ndarray) -> np.ndarray:
    """The rows with a symbol (not an end), by symbol and then by row."""
    order = np.argsort(symbols, kind="stable")
    return order[len(order) - np.count_nonzero(symbols) :]


def collection_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(transform, longest common prefixes) of all suffixes of the strings.

    Symbols are byte + 1; 0 ends a string, and ends are ordered by string.  The first
    len(strings) rows are the empty suffixes.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    small = np.uint16 if len(flat) and flat.max() == 255 else np.uint8  # UTF-8 has no byte 255
    flat = flat.astype(np.uint32) + np.uint32(1)
    files = ColumnFiles()
    try:
        files.write(np.where(sizes > 0, flat[np.maximum(ends - 1, 0)] if len(flat) else 0, 0).astype(np.uint32))
        rows = active = np.flatnonzero(sizes > 0)  # strings with symbols left, and the rows of their latest suffixes
        for done in range(1, int(sizes.max(initial=0)) + 1):
            packed = files.read()
            symbols = (packed & _SYMBOL).astype(small)
            # the new rows are ordered as the old rows that hold their first symbols
            order = by_symbol(symbols)
            place = np.empty(len(symbols), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            mine = place[rows]
            sort = np.argsort(mine)
            active, rows, mine = active[sort], rows[sort], mine[sort]
            own = symbols[rows]
            at = mine + np.int64(m)
            # the common prefix with the row before: one more than the least between the two
            # earlier rows of the same symbol; 0 at the first row of a symbol
            before = order[np.maximum(mine - 1, 0)]
            has_before = (mine > 0) & (symbols[before] == own)
            after = order[np.minimum(mine + 1, len(order) - 1)]
            has_after = (mine + 1 < len(order)) & (symbols[after] == own)
            low = np.concatenate([before[has_before], rows[has_after]])
            high = np.concatenate([rows[has_before], after[has_after]])
            least = np.empty(len(low), np.uint32)
            if len(low):
                back = np.argsort(-high, kind="stable")
                bounds = np.empty(2 * len(low), np.int64)
                bounds[0::2], bounds[1::2] = low[back] + 1, high[back] + 1
                least[back] = np.minimum.reduceat(np.append(packed, np.uint32(0)), bounds)[0::2] >> _BITS
            k = int(has_before.sum())
            prefix = np.zeros(len(rows), np.uint32)
            prefix[has_before] = least[:k] + np.uint32(1)
            left = sizes[active] - done
            # one sequential pass: old rows in their order, new rows in their places
            is_old = np.ones(len(packed) + len(active), bool)
            is_old[at] = False
            merged = np.empty(len(is_old), np.uint32)
            merged[is_old] = packed
            merged[at] = (prefix << _BITS) | np.where(left > 0, flat[np.maximum(ends[active] - done - 1, 0)], np.uint32(0))
            shifted = at[has_after] + 1
            merged[shifted] = ((least[k:] + np.uint32(1)) << _BITS) | (merged[shifted] & _SYMBOL)
            files.write(merged)
            more = left > 0
            active, rows = active[more], at[more]
        packed = files.read()
        return (packed & _SYMBOL).astype(np.uint16), (packed >> _BITS).astype(np.int32)
    finally:
        files.close()


def suffix_rows(symbols: np.ndarray, sizes: np.ndarray):
    """For 1, 2, ...: (strings so long, rows of their suffixes of that length), by walking the transform."""
    m = len(sizes)
    order = by_symbol(symbols)
    following = np.zeros(len(symbols), np.int64)
    following[order] = np.arange(len(order)) + m
    strings = np.flatnonzero(sizes > 0)
    rows = strings
    for n in range(1, int(sizes.max(initial=0)) + 1):
        rows = following[rows]
        yield n, strings, rows
        more = sizes[strings] > n
        strings, rows = strings[more], rows[more]


def window_classes(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of every window of length bytes; equal windows share a class."""
    symbols, prefixes = collection_bwt(strings)
    groups = np.cumsum(prefixes < length)
    sizes = np.array([len(s) for s in strings], np.int64)
    who, start, of = [], [], []
    for n, members, rows in suffix_rows(symbols, sizes):
        if n >= length:
            who.append(members)
            start.append(sizes[members] - n)
            of.append(groups[rows])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, start, of))


def _fragments(rows: DataFrame, length: int, size: int) -> DataFrame:
    """id, copies, start (of the first window), windows, left (bytes before the anchor), fp, digest and
    the fragment's bytes."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for i, n, text, at in zip(*(batch.column(c).to_pylist() for c in ("id", "copies", "text", "at")), strict=True):
                data = raw_bytes(text).tobytes()
                hashes, found = anchors(units(text, "bytes"), length, size)
                good = alive(found, at, len(hashes))
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                last = np.append(first[1:], len(found))
                use = good[first]
                at_anchor = found[first[use]]
                for s, e, a, fp in zip(first[use].tolist(), last[use].tolist(), at_anchor.tolist(), hashes[at_anchor].view(np.int64).tolist(), strict=True):
                    body = data[s : e - 1 + length]
                    for column, x in zip(out, (i, n, s, e - s, a - s, fp, hashlib.blake2b(body, digest_size=16).digest(), body), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["id", "copies", "start", "windows", "left", "fp", "digest", "body"])

    return rows.mapInArrow(run, "id long, copies long, start int, windows int, left int, fp long, digest binary, body binary")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


def _longest_shared(parts: list[bytes]) -> list[int]:
    """For each part the longest prefix that another part has too."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(rows: list[tuple[bytes, int]], size: int, length: int) -> dict[bytes, list[tuple[int, int]]]:
    """rows (body, place of the anchor in it), distinct, of one anchor -> piece: (row, where it begins in the row)."""
    right = _longest_shared([body[left + size :] for body, left in rows])
    before = _longest_shared([body[:left][::-1] for body, left in rows])
    pieces: dict[bytes, list[tuple[int, int]]] = {}
    for k, (body, left) in enumerate(rows):
        low, high = left - before[k], left + size + right[k]
        if high - low >= length:
            pieces.setdefault(body[low:high], []).append((k, low))
    return pieces


def _constructed(fragments: DataFrame, length: int, size: int) -> DataFrame:
    """fragments (fp, salt, salts, digest, weight, left, body), sorted by (fp, salt) within partitions ->
    fp, digest, lows and highs (runs of starts of repeated windows); where there are salts, classes (a digest for
    each window) and weights, and the salt."""
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64())

    def batch_of(found: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=["fp", "digest", "lows", "highs", "classes", "weights", "salt"])

    def salted(rows: list[tuple]):
        who, start, of = window_classes([r[6] for r in rows], length)
        total = np.bincount(of, weights=np.array([r[4] for r in rows], np.int64)[who]).astype(np.int64)
        order = np.lexsort((start, who))
        who, start, of = who[order], start[order], of[order]
        bounds = np.searchsorted(who, np.arange(len(rows) + 1))
        for k, (fp, salt, _, digest, _, _, body) in enumerate(rows):
            own = slice(bounds[k], bounds[k + 1])
            yield fp, digest, [], [], [hashlib.blake2b(body[x : x + length], digest_size=16).digest() for x in start[own].tolist()], total[of[own]].tolist(), salt

    def solved(groups: list[tuple[list[tuple], dict]]):
        """groups: (rows, pieces) of anchors; one construction over the pieces of all that have several."""
        strings, weights, owner = [], [], []
        flags: dict[tuple[int, int], list[np.ndarray]] = {}
        for g, (rows, pieces) in enumerate(groups):
            for piece, members in pieces.items():
                weight = sum(rows[k][4] for k, _ in members)
                if len(pieces) > 1:
                    strings.append(piece)
                    weights.append(weight)
                    owner.append((g, members))
                elif weight >= 2:
                    for k, low in members:
                        flags.setdefault((g, k), []).append(np.arange(low, low + len(piece) - length + 1))
        if strings:
            # pieces of unlike anchors never share a window, so one construction serves many anchors
            who, start, of = window_classes(strings, length)
            repeated = np.bincount(of, weights=np.array(weights, np.int64)[who])[of] >= 2
            order = np.argsort(who[repeated], kind="stable")
            who, start = who[repeated][order], start[repeated][order]
            bounds = np.searchsorted(who, np.arange(len(strings) + 1))
            for k, (g, members) in enumerate(owner):
                own = start[bounds[k] : bounds[k + 1]]
                if len(own):
                    for row, low in members:
                        flags.setdefault((g, row), []).append(own + low)
        for g, (rows, _) in enumerate(groups):
            for k, (fp, _, _, digest, weight, _, body) in enumerate(rows):
                if weight >= 2:
                    yield fp, digest, [0], [len(body) - length + 1], None, None, None
                elif (g, k) in flags:
                    good = np.zeros(len(body) - length + 1, bool)
                    good[np.concatenate(flags[g, k])] = True
                    yield fp, digest, *runs(good), None, None, None

    def run(batches):
        group: list[tuple] = []
        waiting: list[tuple[list[tuple], dict]] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "salt", "salts", "digest", "weight", "left", "body")), strict=True):
                if group and row[:2] != group[0][:2]:
                    if group[0][2] > 1:
                        yield batch_of(list(salted(group)))
                    else:
                        waiting.append((group, trimmed([(r[6], r[5]) for r in group], size, length)))
                        held += sum(len(r[6]) for r in group)
                        if held >= CHUNK:
                            yield batch_of(list(solved(waiting)))
                            waiting, held = [], 0
                    group = []
                group.append(row)
        if group and group[0][2] > 1:
            yield batch_of(list(salted(group)))
        elif group:
            waiting.append((group, trimmed([(r[6], r[5]) for r in group], size, length)))
        if waiting:
            yield batch_of(list(solved(waiting)))

    return fragments.mapInArrow(run, "fp long, digest binary, lows array<int>, highs array<int>, classes array<binary>, weights array<long>, salt long")


def repeated_strings(docs: DataFrame, length: int, scratch: Scratch, size: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """text_hash, lows, highs: runs of starts of repeated windows, of texts without a copy."""
    texts_ = anchored(docs, "bytes", length, size, scratch)
    every = scratch.write(_fragments(with_text(docs, surviving(texts_, scratch, "0"), texts_), length, size), "fragments")
    distinct = every.groupBy("fp", "digest").agg(F.sum("copies").alias("weight"), F.first("body").alias("body"), F.first("left").alias("left"), F.first("windows").alias("windows"))
    distinct = scratch.write(distinct, "distinct")
    counts = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    several = distinct.join(counts.where("n > 1"), "fp").withColumn("salts", F.ceil(F.col("n") / group))
    several = several.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts"))).select("fp", "salt", "salts", "digest", "weight", "left", "body")
    built = scratch.write(_constructed(several.repartition("fp", "salt").sortWithinPartitions("fp", "salt"), length, size), "built")

    alone = distinct.where("weight >= 2").join(counts.where("n = 1"), "fp", "left_semi")
    flags = alone.select("fp", "digest", F.array(F.lit(0)).alias("lows"), F.array("windows").alias("highs"))
    flags = flags.unionByName(built.where("classes is null").select("fp", "digest", "lows", "highs"))
    # a class of a salted anchor has its weight once in each salt
    salted = built.where("classes is not null")
    pairs = salted.select("fp", "digest", "salt", F.posexplode(F.arrays_zip("classes", "weights")).alias("start", "c")).select("fp", "digest", "salt", "start", "c.classes", "c.weights")
    by_class = pairs.groupBy("fp", "classes", "salt").agg(F.max("weights").alias("w")).groupBy("fp", "classes").agg(F.sum("w").alias("w")).where("w >= 2")
    by_class = scratch.write(by_class, "salted-classes")
    again = pairs.join(by_class, ["fp", "classes"], "left_semi").groupBy("fp", "digest").agg(F.collect_list("start").alias("lows"))
    again = again.withColumn("highs", F.transform("lows", lambda x: x + 1))
    flags = flags.unionByName(again)

    single = every.where("copies = 1").select("id", "fp", "digest", "start").join(flags, ["fp", "digest"])
    moved = lambda c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("start")))).alias(c)
    found = single.groupBy("id").agg(moved("lows"), moved("highs"))
    return texts_.select("id", "text_hash").join(found, "id").select("text_hash", "lows", "highs")


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(spark, "suffix-dedup")
    once = repeated_strings(docs, length, scratch, size, group).select("text_hash", F.lit(False).alias("whole"), "lows", "highs")
    none = F.array().cast("array<int>")
    marks = once.unionByName(copied(scratch).select("text_hash", F.lit(True).alias("whole"), none.alias("lows"), none.alias("highs")))
    marks = scratch.write(marks, "marks")
    scratch.clear("marks")
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            rows = zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), arrays(batch.column("lows")), arrays(batch.column("highs")), strict=True)
            for text, whole, lows, highs in rows:
                data = raw_bytes(text)
                gone = np.zeros(len(data), bool)
                if whole and len(data) >= length:
                    gone[:] = True
                elif len(lows):
                    gone = covered_runs(lows, highs, length, len(data))
                n.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(len(runs(gone)[0]))
                kept.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = hashed(docs).join(marks, "text_hash", "left").select("doc_id", "text", "whole", "lows", "highs")
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, table(spark, sf_dir, "documents"))
