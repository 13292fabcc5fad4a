"""Fingerprints, spelling variants and vector codes against brute force, and on odd tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from pricewatch_spark.llm import fingerprints, spelling, vector_codes
from pricewatch_spark.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"


def odd_texts():
    r = random.Random(3)
    base = "".join(r.choices("abcdé \n😀", k=900))
    return [base, base, base[:450] + "x" + base[450:], base[:300], None, "", "a", "ab", "abc", "é😀é", "z" * 20_000, base + "tail", "A" + base]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id", "en", "s", 0), (None, None, None, None, None), (3, "again", "en", "s", 0), (4, None, "en", "s", 0), (4, None, "en", "s", 0)]
    # columns whose names clash with the operators' own
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS range", "'x' AS tail", "2 AS word", "3 AS n", "'y' AS text_hash").repartition(3)


# --- fingerprints ------------------------------------------------------------------------------------


def test_spans_and_extensions_equal_brute_force():
    r = random.Random(1)
    words = ["".join(r.choices("ab", k=r.randint(0, 60))) for _ in range(40)]
    arrays = fingerprints.PrefixHashes(words)
    whole = "".join(words)
    places = [(r.randrange(len(words)), r.randrange(len(words))) for _ in range(400)]
    a, b, most, expected = [], [], [], []
    for x, y in places:
        i, j = r.randint(0, len(words[x])), r.randint(0, len(words[y]))
        p, q = words[x][i:], words[y][j:]
        a.append(arrays.starts[x] + i)
        b.append(arrays.starts[y] + j)
        most.append(min(len(p), len(q)))
        expected.append(len(os.path.commonprefix([p, q])))
    a, b, most = (np.array(x, np.int64) for x in (a, b, most))
    assert arrays.extensions(a, b, most).tolist() == expected
    half = most // 2
    assert arrays.equal(a, b, half).tolist() == [whole[i : i + n] == whole[j : j + n] for i, j, n in zip(a, b, half, strict=True)]


def common(a, b):
    """The last place of the grid up to which two texts agree, judged on the texts."""
    places = [p for p in fingerprints.grid(max(len(a), len(b), 1)).tolist() if p < min(len(a), len(b)) and a[:p] == b[:p]]
    return max(places, default=0)


def alike(a, b):
    return 1.0 if a == b else min(common(a, b) + common(a[::-1], b[::-1]), len(a), len(b)) / max(len(a), len(b))


def expected_neighbours(rows):
    """rows: (doc_id, text) in the operator's order."""
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, after), len(os.path.commonprefix([t, edited])), len(os.path.commonprefix([t, after]))))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.common_edited, r.common_next) for r in df.collect()), key=repr)


def in_order(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5(x[1].encode()).digest()))


def test_fingerprints_of_odd_rows(spark, odd):
    rows = in_order((r.doc_id, r.text) for r in odd.collect())
    found = fingerprints.against_neighbours(odd)
    assert rows_of(found) == sorted(expected_neighbours(rows), key=repr)
    names = collections.defaultdict(set)
    by_id = fingerprints.fingerprints(odd).collect()
    for (_, t), f in zip(sorted(rows, key=repr), sorted(((r.doc_id, r.fingerprint, r.n_chars) for r in by_id), key=repr), strict=True):
        names[t].add(f[1]) if f[0] is not None and sum(x[0] == f[0] for x in rows) == 1 else None
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)
    one = {str(fingerprints.PrefixHashes([t]).fingerprints()[0]) for t in odd_texts() if t}
    assert one <= {r.fingerprint for r in by_id} and one <= {r.fingerprint for r in found.collect()}
    assert fingerprints.against_neighbours(odd.limit(0)).collect() == []
    single = fingerprints.against_neighbours(odd.where("doc_id = 8")).collect()
    assert [(r.near_next, r.common_next) for r in single] == [(1.0, 3)]


def test_fingerprints_of_the_table(spark):
    docs = table(spark, SF, "documents")
    rows = in_order((r.doc_id, r.text) for r in docs.collect())
    assert rows_of(fingerprints.query(spark, SF)) == sorted(expected_neighbours(rows), key=repr)


def test_common_extensions(spark):
    rows = [("abcde", 1, "xbcdz", 1, 7), ("aa", 0, "aaaa", 2, 8), (None, 0, "a", 0, 9), ("a", 5, "a", 0, 1), ("a", None, "a", 0, 2), ("a", 1, "a", 1, 3), ("é😀x", 1, "😀xy", 0, 4)]
    pairs = spark.createDataFrame(rows, "text_a string, at_a int, text_b string, at_b int, extra int")
    assert {r.extra: r.extension for r in fingerprints.common_extensions(pairs).collect()} == {7: 3, 8: 2, 9: 0, 1: 0, 2: 0, 3: 0, 4: 2}
    assert fingerprints.common_extensions(pairs.limit(0)).collect() == []


def test_fingerprint_text_round_trip():
    for t in ["", "a", "abc" * 1000]:
        f = fingerprints.PrefixHashes([t]).fingerprints()[0]
        assert fingerprints.Fingerprint.parse(str(f)) == f and fingerprints.likeness(f, f) == 1.0


# --- spelling ----------------------------------------------------------------------------------------


def expected_words(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holes[w[:i] + "*" + w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w) or "", words.get(form.get(w)) or 0, root(w)) for w, n in words.items())


def words_of(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.fixture(scope="module")
def misspelt(spark):
    r = random.Random(9)
    known = ["".join(r.choices("abcàÿ", k=r.randint(7, 12))) for _ in range(40)] + ["ÀaBbCcDd", "x" * 30]
    texts = []
    for i in range(400):
        words = [r.choice(known[: 1 + i % len(known)]) for _ in range(40)]
        for _ in range(6):
            k = r.randrange(len(words))
            w, at = words[k], r.randrange(len(words[k]))
            words[k] = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcàÿ") + w[at + 1 :], w[:at] + r.choice("abÿ") + w[at:]])
        texts.append(r.choice([" ", "1", "×", "ā"]).join(words))
    texts += [None, "", "short", "y" * 1500, "y" * 1500, "Y" * 1499, "Y" * 1499]
    rows = [(None if i % 50 == 7 else i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS word", "1 AS n", "2 AS length")


# the small budgets take several passes and cut lengths into segments
@pytest.mark.parametrize("budget", [spelling.FILTER_BYTES, 256])
def test_spelling_variants_equal_brute_force(spark, misspelt, budget):
    expected = expected_words((r.doc_id, r.text) for r in misspelt.collect())
    assert sum(x[3] != "" for x in expected) > 50
    assert words_of(spelling.spelling_variants(spark, misspelt, budget)) == expected


def test_spelling_of_the_table_and_of_nothing(spark, odd):
    assert words_of(spelling.query(spark, SF)) == expected_words((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    assert spelling.spelling_variants(spark, odd.limit(0)).collect() == []
    assert words_of(spelling.spelling_variants(spark, odd)) == expected_words((r.doc_id, r.text) for r in odd.collect())


def test_filters_stay_within_their_budget():
    for lengths in ({7: 10}, {7: 1000, 8: 5000, 9: 1}, {7: 0, 12: 100_000}):
        for budget in (64, 4096, 1 << 20):
            shards = spelling.passes(lengths, budget)
            assert all(sum(b for _, b in x.values()) * spelling.BLOCK <= budget for x in shards)
            assert sum((list(x) for x in shards), []) and {k for x in shards for k, _ in x} == set(lengths)


def test_forms_follow_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(18)], "word string, form string")
    from pricewatch_spark.llm.common import Scratch

    assert {r.root for r in spelling.roots(chain, Scratch(spark, "chain")).collect()} == {"w18"}


# --- vector codes ------------------------------------------------------------------------------------


def expected_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label)."""
    good = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    length = max([4] + [-(-len(v) // 4) * 4 for _, v, _ in good])
    whole = [[max(-(2**60), min(2**60, math.floor(c * 1024))) for c in v] + [0] * (length - len(v)) for _, v, _ in good]
    order = sorted((k for k in range(len(good)) if good[k][0] is not None), key=lambda k: (good[k][0], whole[k])) or sorted(range(len(good)), key=lambda k: whole[k])
    w = length // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(whole[k], p) for k in order[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, book: min((distance(v, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for v in whole:
                got[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for j, mine in got.items():
                books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, by_label = [], collections.Counter()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    for (i, _, x), v in zip(good, whole, strict=True):
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = min(2**63 - 1, sum(d for d, _ in found))
        by_label[x] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, x))
    return sorted(((i, c, e, min(by_label[x], 2**63 - 1), sha) for i, c, e, x in out), key=repr)


def codes_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_vector_codes_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)], r.choice([None, 1, 2, 3])) for i in range(300)]
    rows += [(i, [0.5, -0.25] * 4, 1) for i in range(500, 520)]
    rows += [(600, None, 1), (601, [None] * 8, 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] + [0.0] * 7, None), (604, [], 2), (605, [1.0], 2), (606, [0.1] * 9, 3)]
    rows += [(None, [0.2] * 8, None), (7, [0.9] * 8, 9), (7, [0.9] * 8, 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS parts", "2 AS n").repartition(3)
    assert codes_of(vector_codes.vector_codes(spark, vectors)) == expected_codes(rows)


def test_vector_codes_of_few_large_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int"
    large = [(i, [float(10 ** (i % 30)) * (-1) ** i, 1.5, 2.0**k, -3.0] * 2, i % 2) for i, k in enumerate(range(0, 40, 2))] + [(90, [1e300, -1e300, 5e-324, 0.0] * 2, 1)]
    assert codes_of(vector_codes.vector_codes(spark, spark.createDataFrame(large, kind))) == expected_codes(large)
    few = [(3, [0.1, 0.2, 0.3, 0.4], 1), (2, [0.1, 0.2, 0.3, 0.4], None), (None, [0.0] * 4, 2)]
    assert codes_of(vector_codes.vector_codes(spark, spark.createDataFrame(few, kind))) == expected_codes(few)
    assert vector_codes.vector_codes(spark, spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    assert vector_codes.vector_codes(spark, spark.createDataFrame([], kind)).collect() == []


def test_pivots_rule_entries_out():
    r = np.random.default_rng(2)
    centres = r.integers(-3000, 3000, (256, 4))
    parts = (centres[r.integers(0, 256, 2000)] + r.integers(-20, 20, (2000, 4))).astype(np.int64)
    fixed = vector_codes.pivots(centres)
    books = vector_codes.Codebooks([centres], [fixed])
    found, distance, evaluated = vector_codes.assign(parts, vector_codes.roots(parts, fixed).astype(np.float32), centres, books.to_pivots[0])
    every = ((parts[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert evaluated < 0.1 * every.size
