"""LM scoring with a Brown class-based bigram model.

Tokens are words (A-Z in lower case) and one end a text.  Units are what is clustered: every word
seen LEAST times or more, the end, and one unit for each of ENDINGS hashes of a word's last three
bytes, which takes the words seen less often.  Exchange clustering assigns units to CLASSES
classes: in every round the FREQUENT most frequent words and the endings move one after another on
the driver, then all other words at once in Spark, each to the class that raises the class bigram
likelihood most, of the SHORT that look best to first order.  Rounds end with the first that
raises the log likelihood by at most TOLERANCE a token (0: when nothing moves).  Tasks get 8 bytes
of hash and 1 of class for each unit, and tell 2 to 4 more bytes of places from the hashes.

    p(word | before) = p(class | class before) * p(unit | class) * p(word | unit)

Class transitions are interpolated with class frequencies; units and words are smoothed by adding
0.1, with one unseen word a unit, so the model is a distribution over known words and one unseen
word an ending.  Counts are over all training texts.  The counts of words without a unit meet the
texts in a join.

Defined results: null and empty texts are one end; rows with a null doc_id are scored but not
learned from (held_out is false); repeated rows count and are scored row by row; without training
texts N and V are 0 and the scores are those of the smoothing alone; very long texts are scored
whole in one task; ties between classes go to the first; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import BASE, Scratch, as_long, fold_ascii, mix, raw_bytes, remainder, table, texts, word_hashes

NAME = "op10_class_lm"
ORACLE_SQL = None
FREQUENT = 2000
ENDINGS = 500
LEAST = 5  # a word seen so often is a unit of its own
CLASSES = 64
TOLERANCE = 2e-3  # rounds go on until one raises the log likelihood of the training texts by less, a token
ADD = 0.1
BACK_OFF = 0.03  # share of the class frequencies in a transition
FLUSH = 400_000
HELD = 2_000_000
RUN = 1 << 18  # bytes of texts whose words are told together
PART = 500_000  # tokens a part of the pairs
TOGETHER = 256
SHORT = 6  # classes whose gain is computed exactly, besides a unit's own


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


_CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ending of each word from starts to ends, as ``ending`` gives it, all at once."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        long = ends - starts >= k
        crc = np.where(long, _CRC[(crc ^ data[np.where(long, ends - k, 0)]) & np.uint32(255)] ^ (crc >> np.uint32(8)), crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(ENDINGS)).astype(np.int64)


def runs(column: pa.Array):
    """(bytes in lower case, where each text begins) for runs of whole texts of about RUN bytes.

    A line feed ends each text, so no word crosses texts; what is computed for a word costs the
    same for many short texts as for a long one.
    """
    held, size = [], 0
    for text in column.cast(pa.binary()):
        held.append(text.as_py() or b"")
        size += len(held[-1]) + 1
        if size > RUN:
            yield _run(held)
            held, size = [], 0
    if held:
        yield _run(held)


def _run(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
    return fold_ascii(raw_bytes(b"\n".join(held))), begins


def summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, endings, counts) with each hash once."""
    hashes, tails, n = (np.concatenate(x) for x in zip(*held, strict=True))
    hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes, tails[first], np.bincount(inverse, weights=n, minlength=len(hashes)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """h (a word's hash), ending, c: over all texts."""

    def run(batches):
        def flush(hashes, tails, n):
            columns = [pa.array(as_long(hashes), pa.int64()), pa.array(tails, pa.int32()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["h", "ending", "c"])

        held, size = [], 0
        for batch in batches:
            for data, _ in runs(batch.column("text")):
                hashes, starts, ends = word_hashes(data)
                hashes, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((hashes, endings(data, starts[first], ends[first]), n))
                size += len(hashes)
                if size > 2 * FLUSH:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield flush(*held[0])
                        held, size = [], 0
        if held:
            yield flush(*summed(held))

    return docs.select("text").mapInArrow(run, "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


class Units:
    """Numbers of units: words by hash, then endings, then the end of a text."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # in order
        self.first_ending = len(hashes)
        self.end = self.first_ending + ENDINGS
        self.size = self.end + 1
        self.of = self
        self.first = None

    def __getstate__(self):
        return self.__dict__ | {"first": None}  # each task tells it anew from the hashes

    def __contains__(self, word: bytes) -> bool:
        return self.find(word_hashes(raw_bytes(word))[0])[0] >= 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those without a unit of their own.

        Hashes are even over their range, so their upper bits tell the place within a few steps:
        first holds where the hashes of each value of those bits begin.
        """
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        bits = len(self.hashes).bit_length() - 1
        if self.first is None:
            n = np.bincount(self._upper(self.hashes, bits), minlength=1 << bits)
            self.first = np.minimum(np.cumsum(n) - n, len(self.hashes) - 1).astype(np.int32)
        at = self.first[self._upper(hashes, bits)]
        left = np.flatnonzero(self.hashes[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] < hashes[left]]
        at = np.minimum(at, len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1).astype(np.int64)

    @staticmethod
    def _upper(hashes: np.ndarray, bits: int) -> np.ndarray:
        return (hashes >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words in data: where they begin, numbers (an ending's if rare), the rare ones' places, hashes and endings."""
        hashes, starts, ends = word_hashes(data)
        ids = self.find(hashes)
        rare = np.flatnonzero(ids < 0)
        tails = endings(data, starts[rare], ends[rare])
        ids[rare] = self.first_ending + tails
        return starts, ids, rare, hashes[rare], tails

    def sequence(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a text's words: numbers (an ending's if rare), the rare ones' places, hashes and endings."""
        return self.words(fold_ascii(raw_bytes(text)))[1:]

    def line(self, ids: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a run of texts, an end before the first and after each; the text of each word."""
        of = np.searchsorted(begins, starts, "right") - 1
        line = np.full(len(ids) + len(begins) + 1, self.end, np.int64)
        line[np.arange(len(ids)) + of + 1] = ids
        return line, of


def packed_counts(n: np.ndarray) -> bytes:
    """In as few bytes as the largest count takes."""
    return n.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if n.max(initial=0) <= np.iinfo(k).max)).tobytes()


def counts_of(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) // max(1, size)] if size else np.int64).astype(np.int64)


CHUNK = "part long, size long, keys binary, n binary"


def chunks(parts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their counts, a row a part; keys as differences, which compress well."""
    order = np.argsort(parts, kind="stable")
    own, first = np.unique(parts[order], return_index=True)
    keys, n = np.split(keys[order], first[1:]), np.split(n[order], first[1:])
    columns = [pa.array(own, pa.int64()), pa.array([len(k) for k in keys], pa.int64()), pa.array([np.diff(k, prepend=0).tobytes() for k in keys], pa.binary()), pa.array([packed_counts(x) for x in n], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "size", "keys", "n"])


def merged(batches):
    """(keys, counts) of each part, whose rows come one after another; not in order."""
    part, held = None, []
    for batch in batches:
        for k, size, keys, n in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "keys", "n")), strict=True):
            if k != part and held:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            part = k
            held.append((np.cumsum(np.frombuffer(keys, np.int64)), counts_of(n, size)))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def blocks(docs: DataFrame, units: Units, tokens_: int) -> DataFrame:
    """The neighbours of each unit over all texts (a text begins after an end), whole units packed to
    blocks: units, entries of each, other (twice the neighbour's number, one more if it comes after
    the unit), n.

    Pairs of neighbours are counted in the tasks that read texts, then by parts of the pairs, and
    then dealt by unit to blocks; the more tokens_ there are, the more parts.  A frequent unit's
    pairs lie in many parts, and its block gets each of its neighbours once.
    """
    parts = max(16, tokens_ // PART)

    def count(batches):
        keys, held = [], 0
        for batch in batches:
            for data, begins in runs(batch.column("text")):
                starts, ids, *_ = units.words(data)
                line = units.line(ids, starts, begins)[0]
                keys.append(line[:-1] << 31 | line[1:])
                held += len(keys[-1])
                if held > HELD:
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield chunks(part_of(found, parts), found, n)
                    keys, held = [], 0
        if keys:
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            yield chunks(part_of(found, parts), found, n)

    def deal(batches):
        for keys, n in merged(batches):
            found, inverse = np.unique(keys, return_inverse=True)
            n = np.bincount(inverse, weights=n, minlength=len(found)).astype(np.int64)
            u, v = found >> 31, found & 0x7FFFFFFF
            both = np.concatenate([v << 32 | u << 1, u << 32 | v << 1 | 1])
            order = np.argsort(both)
            yield chunks(part_of(both[order] >> 32, parts), both[order], np.concatenate([n, n])[order])

    def pack(batches):
        for keys, n in merged(batches):
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            own, sizes = np.unique(keys >> 32, return_counts=True)
            columns = [own.astype(np.uint32).tobytes(), sizes.astype(np.uint32).tobytes(), (keys & 0xFFFFFFFF).astype(np.uint32).tobytes(), packed_counts(n)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], names=["units", "sizes", "other", "n"])

    pairs = together(docs.select("text").mapInArrow(count, CHUNK)).mapInArrow(deal, CHUNK)
    return together(pairs).mapInArrow(pack, "units binary, sizes binary, other binary, n binary")


def rows_of_blocks(batches):
    """units, sizes, other, n of each block."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("units", "sizes", "other", "n")), strict=True):
            own, sizes, other = (np.frombuffer(x.as_buffer(), np.uint32) for x in row[:3])
            yield own.astype(np.int64), sizes, other, counts_of(row[3].as_py(), len(other))


def context_counts(sizes: np.ndarray, other: np.ndarray, n: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """The counts of the classes before and after each unit (units x 2 x classes)."""
    key = (np.repeat(np.arange(len(sizes)) * 2, sizes) + (other & 1)) * n_classes + classes[other >> 1]
    return np.bincount(key, weights=n, minlength=len(sizes) * 2 * n_classes).reshape(len(sizes), 2, n_classes)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    return float(_entropy(pairs).sum() - _entropy(pairs.sum(0)).sum() - _entropy(pairs.sum(1)).sum())


def contexts(packed: DataFrame, classes: np.ndarray, n_classes: int, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class bigrams, left, right): left and right are the classes before and after each unit in head."""
    is_head = np.zeros(len(classes), bool)
    is_head[head] = True

    def run(batches):
        pairs = np.zeros(n_classes * n_classes)
        for own, sizes, other, n in rows_of_blocks(batches):
            mine = np.repeat(classes[own].astype(np.int64) * n_classes, sizes)
            pairs += np.bincount(mine + classes[other >> 1], weights=n * (other & 1), minlength=len(pairs))
            kept = is_head[own]
            if kept.any():
                entries = np.repeat(kept, sizes)
                counts = context_counts(sizes[kept], other[entries], n[entries], classes, n_classes)
                yield pa.RecordBatch.from_arrays([pa.array(own[kept], pa.int32()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["unit", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pairs.tobytes()], pa.binary())], names=["unit", "counts"])

    got = packed.mapInArrow(run, "unit int, counts binary").toArrow()  # a row a unit in head, one a task
    pairs = np.zeros((n_classes, n_classes))
    at = {int(u): k for k, u in enumerate(head)}
    sides = np.zeros((len(head), 2, n_classes))
    for u, data in zip(got.column("unit").to_pylist(), got.column("counts").to_pylist(), strict=True):
        if u < 0:
            pairs += np.frombuffer(data).reshape(n_classes, n_classes)
        else:
            sides[at[u]] = np.frombuffer(data).reshape(2, n_classes)
    return pairs, sides[:, 0], sides[:, 1]


def shortlist(counts: np.ndarray, own: np.ndarray, pairs: np.ndarray, fixed: int) -> np.ndarray:
    """The SHORT classes that look best for each unit to first order, and its own as the last."""
    logs, n = np.log(pairs + 0.5), counts[:, 1].sum(1)
    looks = counts[:, 0] @ logs + counts[:, 1] @ logs.T - n[:, None] * (np.log(pairs.sum(1) + 0.5) + np.log(pairs.sum(0) + 0.5))
    looks[:, fixed] = -np.inf
    best = min(SHORT, looks.shape[1] - 1)
    return np.column_stack([np.argpartition(-looks, best - 1, axis=1)[:, :best], own])


def gains(counts: np.ndarray, own: np.ndarray, pairs: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The likelihood of each unit in each class of its choice, itself taken out of its class ``own``."""
    left, right = counts[:, 0], counts[:, 1]
    units = np.arange(len(own))
    mine_too = choice == own[:, None]
    n = right.sum(1)
    out = np.zeros(choice.shape)
    for mine, other, table in ((left, right, pairs), (right, left, pairs.T)):
        w, c = np.nonzero(mine)
        m = mine[w, c]
        base = table[c[:, None], choice[w]]
        inside = np.flatnonzero(c == own[w])
        base[inside] -= other[w[inside, None], choice[w[inside]]]
        base -= m[:, None] * mine_too[w]
        np.maximum(base, 0, out=base)
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        if len(w):
            out[w[first]] += np.add.reduceat(_entropy(base + m[:, None]) - _entropy(base), first)
    for mine, total in ((left, pairs.sum(1)), (right, pairs.sum(0))):
        rest = total[choice] - mine[units[:, None], choice] - n[:, None] * mine_too
        np.maximum(rest, 0, out=rest)
        out -= _entropy(rest + n[:, None]) - _entropy(rest)
    return out


def proposals(packed: DataFrame, classes: np.ndarray, pairs: np.ndarray, head: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, class, gain) of the units outside head that would gain by a move to their best class.

    A task's class bigrams follow its own moves, so later units see earlier ones of the task.
    """
    n_classes = len(pairs)
    is_head = np.zeros(len(classes), bool)
    is_head[head] = True

    def run(batches):
        table, each = pairs.copy(), np.arange(n_classes)[:, None]
        for own, sizes, other, n in rows_of_blocks(batches):
            counts = context_counts(sizes, other, n, classes, n_classes)
            kept = np.flatnonzero(~is_head[own] & counts[:, 1].any(1))
            for j in range(0, len(kept), TOGETHER):
                part = kept[j : j + TOGETHER]
                now = classes[own[part]].astype(np.int64)
                choice = shortlist(counts[part], now, table, int(classes[fixed]))
                gain = gains(counts[part], now, table, choice)
                at, best = np.arange(len(part)), gain.argmax(1)
                more = gain[at, best] - gain[:, -1]
                to = choice[at, best]
                moved = np.flatnonzero((to != now) & (more > 1e-9))
                if len(moved):
                    step = (to[moved] == each).astype(float) - (now[moved] == each)  # whole numbers, so sums are exact
                    table += (counts[part[moved], 0].T @ step.T) + step @ counts[part[moved], 1]
                np.maximum(table, 0, out=table)
                yield pa.RecordBatch.from_arrays([pa.array(own[part[moved]], pa.int32()), pa.array(to[moved].astype(np.int16), pa.int16()), pa.array(more[moved], pa.float64())], names=["unit", "class", "gain"])

    got = packed.mapInArrow(run, "unit int, class short, gain double").toArrow()  # 14 bytes a unit that moves
    return tuple(got.column(c).to_numpy() for c in ("unit", "class", "gain"))


def cluster(packed: DataFrame, classes: np.ndarray, n_classes: int, head: np.ndarray, fixed: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(classes, class bigrams, likelihood after each round): exchange until a round raises it by
    less than tolerance a token.

    A round moves the units of head one after another, then a share of all others at once, each to
    its best class.  Moves made together disturb each other: the share falls where they bring less
    than half of their gains and rises where they bring most of them, and if a round's moves don't
    raise the likelihood, half of the others stay where they were, and so on, and at last the head.
    So no round lowers the likelihood.
    """
    share, tried_head = 1.0, True
    pairs, left, right = contexts(packed, classes, n_classes, head)
    tokens_ = max(1.0, pairs.sum())
    reached = [likelihood(pairs)]
    while True:
        after_head, between = classes.copy(), pairs.copy()
        if tried_head:
            mine = classes[head].copy()
            exchange(left, right, mine, n_classes, int(np.flatnonzero(head == fixed)[0]), between)
            after_head[head] = mine
        unit, best, gain = proposals(packed, after_head, between, head, fixed)
        order = np.argsort(mix(unit.astype(np.uint64) * BASE + np.uint64(len(reached))), kind="stable")  # another share each round
        order = order[: int(np.ceil(share * len(order)))]
        expected = likelihood(between) - reached[-1] + gain[order].sum()
        while True:
            tried = after_head.copy()
            tried[unit[order]] = best[order]
            fresh = contexts(packed, tried, n_classes, head)
            now = likelihood(fresh[0])
            if now > reached[-1] or not len(order):
                break
            order = order[: len(order) // 2]
        share = max(share / 2, 1 / 64) if now - reached[-1] < 0.5 * expected else min(1.0, 1.5 * share)
        if now > reached[-1]:
            classes, (pairs, left, right) = tried, fresh
        elif tried_head:  # counts of a unit beside itself are not exact in a move
            tried_head = False
            continue
        reached.append(max(now, reached[-1]))
        if reached[-1] - reached[-2] <= tolerance * tokens_:
            return classes, pairs, reached


def exchange(left: np.ndarray, right: np.ndarray, classes: np.ndarray, n_classes: int, fixed: int, pairs: np.ndarray | None = None) -> int:
    """One round: each unit moves to the class of the greatest likelihood; the moves made.

    left, right: the classes before and after each unit at the round's begin.  Class bigrams are
    kept up to date, so later units see earlier moves; the unit ``fixed`` stays in its own class.
    pairs: the class bigrams (changed in place), those of the given units alone if None.
    """
    if pairs is None:
        pairs = np.zeros((n_classes, n_classes))
        np.add.at(pairs, classes, right)
    moves = 0
    for k in np.argsort(-right.sum(1), kind="stable"):
        own = classes[k]
        if k == fixed or not right[k].any():
            continue
        base = pairs.copy()
        base[:, own] -= left[k]
        base[own, :] -= right[k]
        np.maximum(base, 0, out=base)
        before, after = base.sum(1), base.sum(0)
        n = right[k].sum()
        gain = (_entropy(base + left[k][:, None]) - _entropy(base)).sum(0) + (_entropy(base + right[k][None, :]) - _entropy(base)).sum(1)
        gain -= _entropy(before + n) - _entropy(before) + _entropy(after + n) - _entropy(after)
        gain[classes[fixed]] = -np.inf
        best = int(gain.argmax())
        if best != own and gain[best] > gain[own] + 1e-9:
            moves += 1
            classes[k] = best
        base[:, classes[k]] += left[k]
        base[classes[k], :] += right[k]
        pairs[:] = base
    return moves


class Model:
    """The counts that tasks need, and the score of a token sequence."""

    def __init__(self, units: Units, classes: np.ndarray, pairs: np.ndarray, unit_counts: np.ndarray, inside: np.ndarray, kinds: np.ndarray, total: int, distinct: int, docs: int):
        self.units, self.classes, self.counts = units, classes, unit_counts
        self.total, self.distinct, self.docs = total, distinct, docs
        n_classes = len(pairs)
        of_class = np.bincount(classes, weights=unit_counts, minlength=n_classes)
        size = np.bincount(classes, minlength=n_classes)
        share = (of_class + ADD) / (of_class.sum() + ADD * n_classes)
        seen = pairs.sum(1, keepdims=True)
        kept = np.where(seen > 0, 1 - BACK_OFF, 0.0)
        self.transition = np.log10(kept * pairs / np.maximum(seen, 1) + (1 - kept) * share[None, :])
        self.unit = np.log10((unit_counts + ADD) / (of_class[classes] + ADD * size[classes]))
        # words of an ending: inside is their count, kinds how many distinct
        self.inside = inside + ADD * (kinds + 1)

    def base(self, c):
        return np.log10((np.asarray(c, float) + ADD) / (self.total + ADD * (self.distinct + 1)))


def train(spark: SparkSession, docs: DataFrame, scratch: Scratch, n_classes: int = CLASSES, tolerance: float = TOLERANCE) -> tuple[Model, DataFrame]:
    """(model, word counts of all training words)."""
    counts = scratch.write(word_counts(docs), "words")
    n_docs = docs.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    own = counts.where(F.col("c") >= LEAST).select("h", "c").toArrow()  # 16 bytes a word with a unit
    hashes, times = own.column("h").to_numpy().view(np.uint64), own.column("c").to_numpy()
    order = np.argsort(hashes)
    units = Units(hashes[order])
    inside, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    by_ending = counts.where(F.col("c") < LEAST).groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # a row an ending
    for r in by_ending:
        inside[r["ending"]], kinds[r["ending"]] = r["c"], r["n"]
    unit_counts = np.concatenate([times[order], inside, [n_docs]]).astype(float)
    packed = scratch.write(blocks(docs, units, int(total)), "bigrams")
    # the end has class 0 for itself; the others begin by rank
    rank = np.empty(units.size, np.int64)
    rank[np.argsort(-unit_counts, kind="stable")] = np.arange(units.size)
    classes = (1 + rank % (n_classes - 1)).astype(np.uint8 if n_classes <= 256 else np.int32)
    classes[units.end] = 0
    head = np.flatnonzero((rank < FREQUENT) | (np.arange(units.size) >= units.first_ending))
    classes, pairs, reached = cluster(packed, classes, n_classes, head, units.end, tolerance)
    total, distinct = int(total) + n_docs, distinct + (1 if n_docs else 0)
    model = Model(units, classes, pairs, unit_counts, inside, kinds, total, distinct, n_docs)
    model.reached = reached
    return model, counts


def _local(docs: DataFrame, model: Model) -> DataFrame:
    """What a task knows of a text by itself: row, doc_id, n_tokens, n_known, base, score, and its rare words."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        units, end = model.units, model.units.end
        base = model.base(model.counts)
        known = model.counts > 0
        for batch in batches:
            out = [[np.empty(0, k)] for k in (np.int64, np.int64, float, float, np.int64, np.int64, np.int32, np.int32)]
            for data, begins in runs(batch.column("text")):
                starts, ids, rare, hashes, tails = units.words(data)
                line, of = units.line(ids, starts, begins)
                n_tokens = np.bincount(of, minlength=len(begins)) + 1
                first = np.cumsum(n_tokens) - n_tokens
                to = line[1:]
                place = model.classes[line].astype(np.int64)
                score = model.transition[place[:-1], place[1:]] + model.unit[to]
                own = np.ones(len(to), bool)
                own[rare + of[rare]] = False
                # the distinct rare words of each text
                order = np.lexsort((hashes, of[rare]))
                words, text, tails = hashes[order], of[rare][order], tails[order]
                new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (text[1:] != text[:-1])][: len(words)])
                times = np.diff(new, append=len(words))
                row = (n_tokens, np.add.reduceat(known[to] & own, first, dtype=np.int64), np.add.reduceat(np.where(own, base[to], 0.0), first))
                row += (np.add.reduceat(score, first), np.bincount(text[new], minlength=len(begins)), as_long(words[new]), times, tails[new])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            *numbers, n_words, words, times, tails = (np.concatenate(x) for x in out)
            ends = pa.array(np.append(0, np.cumsum(n_words)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((words, pa.int64()), (times, pa.int32()), (tails, pa.int32()))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times", "endings"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, k) for x, k in zip(numbers, kinds, strict=True)), *lists], names=names)

    return docs.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>, endings array<int>")


def scores(spark: SparkSession, docs: DataFrame, keep=None, n_classes: int = CLASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    keep: the condition on doc_id for texts to learn from; held_out is its opposite.
    """
    scratch = Scratch(spark, "class-lm")
    keep = keep if keep is not None else (remainder(10) != 0)
    all_docs = texts(docs).withColumn("held_out", F.coalesce(~keep, F.lit(False)))
    model, counts = train(spark, all_docs.where(keep), scratch, n_classes, tolerance)
    local = scratch.write(_local(all_docs, model).withColumn("row", F.monotonically_increasing_id()), "local")
    scratch.clear("words", "local")
    # the rare words of the texts meet their counts; a word that was never seen finds none
    others = local.select("row", F.explode(F.arrays_zip("words", "times", "endings")).alias("x"))
    others = others.select("row", F.col("x.words").alias("h"), "x.times", "x.endings")
    own = counts.where(F.col("c") < LEAST).select("h", "c")
    met = others.join(own, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inside = F.element_at(F.array(*(F.lit(float(x)) for x in model.inside)), F.col("endings") + 1)
    sums = met.groupBy("row").agg(
        F.sum(F.expr("if(c > 0, times, 0)")).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + ADD)).alias("logs"),
        F.sum("times").alias("n"),
        F.sum(F.col("times") * F.log10(inside)).alias("insides"),
    )
    whole = float(np.log10(model.total + ADD * (model.distinct + 1)))
    nothing = lambda c: F.coalesce(c, F.lit(0))
    return local.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + nothing("more_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + nothing("logs") - nothing("n") * whole).alias("base_score"),
        (F.col("score") + nothing("logs") - nothing("insides")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, table(spark, sf_dir, "documents"))
