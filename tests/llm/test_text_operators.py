"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewatch_spark.llm import chat_format, class_lm, decontaminate, media, mixing, near_dedup, quality, substring_dedup, suffix_dedup, toxicity
from pricewatch_spark.llm.common import Scratch, minimisers, remainder, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=5, n=60):
    """Texts with exact, near and partial copies, a shared passage, odd bytes, empty and null texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéñß", k=r.randint(2, 7))) for _ in range(400)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, rows = words(60), []
    for i in range(n):
        own = words(r.randint(20, 160))
        if i % 4 == 0:
            own[10:10] = passage
        if i % 7 == 0 and rows:
            own = WORD.findall(rows[r.randrange(len(rows))] or "") or own
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
        rows.append(r.choice([" ", "  ", "\n"]).join(own))
    rows += [None, "", "   ", "one", "one", "A b", "a b", "x " * 500, rows[0], rows[0], " ".join(words(3000))]
    return rows


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame([(i, t, "en", f"src{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)], DOCS)
    # columns whose names clash with the operators' own
    return df.selectExpr("*", "1 AS size", "'x' AS whole", "2 AS copies", "'y' AS text_hash", "3 AS score").cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_hashing():
    r = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    for n in (1, 5, 35):
        assert len(windows(r, n)) == 201 - n and windows(np.concatenate([r[7:60], r]), n)[0] == windows(r, n)[7]
    found = minimisers(r, 9)
    assert all(found[i] == i + int(np.argmin(r[i : i + 9] >> np.uint64(10))) for i in range(len(found)))


def repeated(units, n):
    counts = collections.Counter(u[k : k + n] for u in units for k in range(len(u) - n + 1))
    out = []
    for u in units:
        gone = bytearray(len(u))
        for k in range(len(u) - n + 1):
            if counts[u[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        out.append(gone)
    return out


def test_substring_dedup(spark, docs, texts):
    units = [tuple(WORD.findall(t or "")) for t in texts]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark, docs, keep_text=True).collect()}
    assert len(got) == len(texts)
    for i, (t, u, gone) in enumerate(zip(texts, units, repeated(units, 35), strict=True)):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "")
        blank = re.match(r"[\x20\x09-\x0D]*", t or "")[0]  # what stands before the first word stays
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(u), sum(gone), blank + "".join(x for x, g in zip(pieces, gone) if not g))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("group", [1024, 2])
def test_suffix_dedup(spark, docs, texts, group):
    """group=2 sends most anchors through the salted way."""
    units = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(spark, docs, group=group).collect()}
    for i, (u, gone) in enumerate(zip(units, repeated(units, 200), strict=True)):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(u), sum(gone), spans)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_collection_transform():
    r = random.Random(1)
    for _ in range(60):
        strings = [bytes(r.choices(b"ab\xff", k=r.randint(0, 12))) for _ in range(r.randint(1, 8))]
        suffixes = sorted(((i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda t: [(x + 1, 0) for x in strings[t[0]][t[1] :]] + [(0, t[0])])
        symbols, prefixes = suffix_dedup.collection_bwt(strings)
        assert list(symbols) == [strings[i][k - 1] + 1 if k else 0 for i, k in suffixes]
        lcp = [0]
        for (i, a), (j, b) in zip(suffixes, suffixes[1:]):
            x, y = strings[i][a:], strings[j][b:]
            lcp.append(next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y))))
        assert list(prefixes) == lcp


def brute_components(texts, words, ids):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        u = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(u[k : k + words]) for k in range(max(1, len(u) - words + 1))) if u else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(spark, docs, texts):
    expected = brute_components(texts, 4, range(len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark, docs, words=4).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in expected.items()}


def test_near_dedup_of_a_large_half_alike_group(spark):
    """Copies of one text with edits around the threshold: many members of every bucket stay apart."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(90):
        own = list(base)
        for at in r.sample(range(120), r.randint(0, 9)):
            own[at] = f"e{r.randrange(6)}" if i % 3 else f"u{i}x{at}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_components(texts, 4, range(len(texts)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark, df, words=4).collect()}
    assert got == {i: c for i, (_, c) in expected.items()}
    assert 1 < len(set(got.values())) < 90


def test_registers_estimate():
    r = np.random.default_rng(2)
    for share in (0.3, 0.8):
        common, a, b = (r.integers(0, 2**63, int(n), dtype=np.uint64) for n in (4000 * share, 2000 * (1 - share), 2000 * (1 - share)))
        x, y = (near_dedup.registers(np.unique(np.concatenate([common, z])))[None] for z in (a, b))
        true = len(common) / (len(common) + len(a) + len(b))
        assert abs(near_dedup.estimate(x, y)[0] - true) < 0.15
    one = near_dedup.registers(np.array([5], np.uint64))
    assert len(set(one.tolist())) == 1


def test_class_lm(spark, docs, texts):
    got = {r["doc_id"]: r for r in class_lm.scores(spark, docs).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_class_lm_scores_against_brute_force(spark, monkeypatch):
    """The score of every text, by counting class bigrams token by token."""
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdeéñ", k=r.randint(2, 5))) for _ in range(90)]
    texts = [None, "", "A a A"] + [" ".join(r.choice(vocabulary[: 30 if i % 2 else 90]) for _ in range(r.randint(1, 40))) for i in range(120)]
    kept, train = [], class_lm.train
    monkeypatch.setattr(class_lm, "train", lambda *a, **b: kept.append(train(*a, **b)) or kept[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in class_lm.scores(spark, docs, n_classes=9).collect()}
    units, classes = kept[0][0].units, kept[0][0].classes
    tokens = [(t or "").encode().lower().split() for t in texts]
    learned = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 10]
    counts = collections.Counter(w for k in learned for w in tokens[k])
    own = {w: int(units.find(np.asarray(class_lm.word_hashes(class_lm.raw_bytes(w))[0]))[0]) for ws in tokens for w in ws}
    assert all((own[w] >= 0) == (counts[w] >= class_lm.LEAST) for w in own)
    unit = lambda w: own[w] if own[w] >= 0 else units.first_ending + class_lm.ending(w)
    lines = {k: [units.end, *(unit(w) for w in tokens[k]), units.end] for k in range(len(texts))}
    times = collections.Counter(u for k in learned for u in lines[k][1:])
    pairs = collections.Counter((classes[a], classes[b]) for k in learned for a, b in zip(lines[k], lines[k][1:]))
    of_class, size, before = collections.Counter(), collections.Counter(classes.tolist()), collections.Counter()
    for u, n in times.items():
        of_class[classes[u]] += n
    for (a, _), n in pairs.items():
        before[a] += n
    kinds, total = 9, sum(times.values())
    for k, line in lines.items():
        p = 0.0
        for a, b, w in zip(line, line[1:], [*tokens[k], None]):
            ca, cb = classes[a], classes[b]
            free = class_lm.BACK_OFF if before[ca] else 1.0
            p += math.log10((1 - free) * pairs[ca, cb] / max(1, before[ca]) + free * (of_class[cb] + 0.1) / (total + 0.1 * kinds))
            p += math.log10((times[b] + 0.1) / (of_class[cb] + 0.1 * size[cb]))
            if w is not None and own[w] < 0:
                same = [x for x in counts if counts[x] < class_lm.LEAST and class_lm.ending(x) == class_lm.ending(w)]
                p += math.log10((counts[w] + 0.1) / (sum(counts[x] for x in same) + 0.1 * (len(same) + 1)))
        assert got[k]["score"] == pytest.approx(p, rel=1e-9)


def test_class_lm_tells_the_words_of_many_texts_at_once(spark, monkeypatch):
    """2,000 short texts take a few passes, not one each, and give what each gives by itself."""
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcDEéñ", k=r.randint(1, 5))) for _ in range(300)]
    texts = ["", None, " \t", *(r.choice([" ", "\n "]).join(r.choice(vocabulary) for _ in range(r.randint(0, 9))) for _ in range(1996)), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, _ = class_lm.train(spark, docs.where("doc_id < 600"), Scratch(spark, "test-lm"), n_classes=9)
    calls, hashed = [], class_lm.word_hashes
    monkeypatch.setattr(class_lm, "word_hashes", lambda data: calls.append(len(data)) or hashed(data))

    class Batches:
        dtypes = [("doc_id", "bigint")]

        def __init__(self, *rows):
            self.rows = rows

        def mapInArrow(self, run, _):
            column = lambda x, k: pa.array([row[x] for row in self.rows], k)
            batch = pa.RecordBatch.from_arrays([column(0, pa.int64()), column(1, pa.string()), pa.array([False] * len(self.rows))], names=["doc_id", "text", "held_out"])
            return [row for b in run(iter([batch])) for row in b.to_pylist()]

    got = class_lm._local(Batches(*enumerate(texts)), model)
    assert len(calls) <= 2 and len(got) == len(texts)
    alone = [class_lm._local(Batches((k, t)), model)[0] for k, t in enumerate(texts)]
    assert [x | {"base": 0, "score": 0} for x in got] == [x | {"base": 0, "score": 0} for x in alone]
    for side in ("base", "score"):
        assert [x[side] for x in got] == pytest.approx([x[side] for x in alone], rel=1e-12)
    assert any(x["words"] for x in got) and any(x["n_known"] > 1 for x in got)


def test_class_lm_finds_units_and_endings():
    """The place by upper bits equals a search; endings told together equal those told word by word."""
    r = np.random.default_rng(9)
    for n in (0, 1, 2, 3, 4, 700, 1024):
        for most in (2**20, 2**64 - 1):  # crowded in one place, even
            hashes = np.unique(np.concatenate([r.integers(0, most, n, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)][: n // 2]]).astype(np.uint64))
            probes = np.concatenate([hashes, r.integers(0, most, 500, dtype=np.uint64), hashes + np.uint64(1)])
            at = {int(h): k for k, h in enumerate(hashes)}
            assert class_lm.Units(hashes).find(probes).tolist() == [at.get(int(h), -1) for h in probes]
    words = ["a", "é", "ab", "我", "aé", "abcd", "x" * 40, "", "\x00"]
    data = class_lm.raw_bytes("".join(words))
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = ends - [len(w.encode()) for w in words]
    assert class_lm.endings(data, starts, ends).tolist() == [class_lm.ending(w.encode()) for w in words]


def test_class_lm_is_a_distribution(spark, docs):
    """After any unit the known words and one unseen word an ending share all probability."""
    scratch = Scratch(spark, "test-lm")
    model, counts = class_lm.train(spark, class_lm.texts(docs), scratch, n_classes=8)
    units = model.units
    within = {e: 0.0 for e in range(class_lm.ENDINGS)}
    for r in counts.collect():
        if units.find(np.array([r["h"]]).view(np.uint64))[0] < 0:
            within[r["ending"]] += (r["c"] + class_lm.ADD) / model.inside[r["ending"]]
    for e in within:
        assert within[e] + class_lm.ADD / model.inside[e] == pytest.approx(1)
    after = 10 ** model.transition[model.classes[units.end]]
    assert after.sum() == pytest.approx(1)
    assert sum(after[model.classes[u]] * 10 ** model.unit[u] for u in range(units.size)) == pytest.approx(1)


def test_class_lm_moves_less_frequent_words_until_nothing_moves(spark, monkeypatch):
    """Words after the most frequent ones, of one ending, go to the classes of their own neighbours."""
    monkeypatch.setattr(class_lm, "FREQUENT", 4)
    r = random.Random(3)
    sides = [[f"{x}{k}end" for k in range(12)] for x in "pq"]
    rows = []
    for i in range(400):
        x = i % 2
        rows.append((i, " ".join(w for _ in range(8) for w in (f"before{x}", r.choice(sides[x]), f"after{x}"))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = class_lm.train(spark, docs, Scratch(spark, "test-lm"), n_classes=7, tolerance=0)
    units = model.units
    found = [{int(model.classes[k]) for k in units.sequence(" ".join(side))[0]} for side in sides]
    assert all(w.encode() in units.of for side in sides for w in side)
    assert [len(f) for f in found] == [1, 1] and found[0] != found[1]
    packed = class_lm.blocks(docs, units, 10_000).cache()
    nobody = np.array([units.end])
    pairs, _, _ = class_lm.contexts(packed, model.classes, 7, nobody)
    assert len(class_lm.proposals(packed, model.classes, pairs, nobody, units.end)[0]) == 0


def test_exchange_raises_likelihood():
    r = np.random.default_rng(4)
    n, k = 30, 4
    pairs = r.integers(0, 5, (n, n)) + 40 * (np.arange(n)[:, None] % 3 == (np.arange(n)[None, :] + 1) % 3)
    classes = 1 + np.arange(n) // 10 % (k - 1)
    classes[0] = 0

    def likelihood():
        m = np.zeros((k, k))
        np.add.at(m, (classes[:, None].repeat(n, 1), classes[None, :].repeat(n, 0)), pairs)
        e = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return e(m) - e(m.sum(0)) - e(m.sum(1))

    start = likelihood()
    for _ in range(5):
        onehot = np.eye(k)[classes]
        if not class_lm.exchange((pairs.T @ onehot).astype(float), (pairs @ onehot).astype(float), classes, k, 0):
            break
    assert likelihood() > start and classes[0] == 0


def test_media(spark, docs, texts):
    got = {}
    stored = media.store(docs)
    for r in media.resolved(media.interleaved(stored, "doc_id"), media.facts(stored), "doc_id").collect():
        got[r["doc_id"]] = r
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["caption"] == f"Payload of {i}" and r["pos"] == 1
        assert media.decode(media.encode(data)) == (len(data), padded)


def test_media_sequences(spark):
    html = '<p>One <b>two</b></p><script>no()</script><figure><img src="media:sha256-ab" alt="alt"><figcaption>Cap &amp; tion</figcaption></figure>tail<img src="http://x/i.png">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    seq = {r["page_id"]: [(i["pos"], i["kind"], i["text"], i["caption"]) for i in r["items"]] for r in media.interleaved(pages).collect()}
    assert seq == {1: [(0, "text", "One two", None), (1, "img", None, "Cap & tion"), (2, "text", "tail", None), (3, "img", None, None)], 2: [], 3: []}
    facts = spark.createDataFrame([("ab", 5)], "digest string, n_bytes long")
    out = media.resolved(media.interleaved(pages), facts, "page_id").orderBy("pos").collect()
    assert [(r["pos"], r["n_bytes"]) for r in out] == [(1, 5), (3, None)]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<figure><figcaption>before</figcaption><img src='a'><img src='b'></figure>x", [("img", "before"), ("img", "before"), ("x", None)]),
        ("<figcaption>alone</figcaption><img src='a'>", [("alone", None), ("img", None)]),
        ("<figure><figcaption>no media</figcaption></figure>", [("no media", None)]),
        ("<figure><img src='a'><figcaption>open</figure><p>rest</p>", [("img", "open"), ("rest", None)]),
        ("<figure><img src='a'><figcaption>open <b>to the end", [("img", "open to the end")]),
    ],
)
def test_captions(html, expected):
    assert [(i["text"] or i["kind"], i["caption"]) for i in media.parse_sequence(html)] == expected


def test_sequences_of_real_pages(spark):
    """All text of the given pages is kept in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["items"] for r in media.interleaved(pages).collect()}
    assert set(got) == set(html) and any(got.values())
    for i, items in got.items():
        assert [x["pos"] for x in items] == list(range(len(items)))
        silent = re.sub(r"(?s)<(script|style|noscript|template)\b.*?</\1>|<!--.*?-->", "", html[i] or "")
        plain = [w for w in re.sub(r"<[^>]*>", " ", silent).split() if w.isalnum()]
        assert {w for w in plain} <= {w for x in items if x["kind"] == "text" for w in x["text"].split()} | {w for x in items for w in (x["caption"] or "").split()}


def test_mixing(spark, docs, texts):
    sizes = [len(WORD.findall(t or "")) for t in texts]
    rows = {r["doc_id"]: r for r in mixing.mix(spark, docs).collect()}
    assert len(rows) == len(texts) and all(rows[i]["size"] == n for i, n in enumerate(sizes))
    by = collections.defaultdict(list)
    for r in rows.values():
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["drawn"]) * r["size"] == r["taken"]
        assert [x["copy"] for x in r["drawn"]] == list(range(len(r["drawn"]))) and all(0 <= x["shard"] < mixing.SHARDS for x in r["drawn"])
    total = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(min(1.5 * sum(sizes), 2 * sum(total.values())))
    for s, rs in by.items():
        assert rs[0]["source_size"] == total[s] and rs[0]["target"] <= 2 * total[s] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs) / 2
    again = {r["doc_id"]: (r["taken"], r["drawn"]) for r in mixing.mix(spark, docs.repartition(3)).collect()}
    assert again == {i: (r["taken"], r["drawn"]) for i, r in rows.items()}
    placed = mixing.shard_rows(mixing.mix(spark, docs)).collect()
    assert sum(r["size"] for r in placed) == sum(r["taken"] for r in rows.values())


def test_mixing_takes_what_the_tree_deals(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_A_BLOCK", 4)
    full = {r["doc_id"]: r for r in mixing.mix(spark, docs, shards=4).collect()}
    tree = mixing.splitting_tree
    # disjoint draws: shard k gets the lots that the tree deals to it, source by source
    dealt = []
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, seed: dealt.append(tree(q, n, seed)) or dealt[-1])
    again = mixing.mix(spark, docs, shards=4).collect()
    assert {r["doc_id"]: r["drawn"] for r in again} == {i: r["drawn"] for i, r in full.items()}
    shards = collections.Counter(x["shard"] for r in again for x in r["drawn"])
    assert set(shards) == set(np.flatnonzero(dealt[0].sum(1)).tolist()) == set(range(4))
    # a tree that loses lots loses their words, and one that deals all to a shard fills that shard
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, seed: tree(q // 2, n, seed))
    fewer = mixing.mix(spark, docs, shards=4).collect()
    assert sum(r["taken"] for r in fewer) < 0.75 * sum(r["taken"] for r in full.values())
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, seed: np.stack([q, *[q * 0] * (n - 1)]))
    assert {x["shard"] for r in mixing.mix(spark, docs, shards=4).collect() for x in r["drawn"]} == {0}


def test_mixing_of_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "d " * 40, "s"), (1, "d " * 40, "s"), (2, None, None), (3, "", "t"), (4, "x " * 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS block", "2 AS pick", "'x' AS in_source")
    got = [(r["doc_id"], r["source"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix(spark, df).collect()]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == [(0, 3, 86), (0, 3, 86), (1, 40, 86), (1, 40, 86), (2, 0, 7), (3, 0, 0), (4, 7, 7)]
    assert all(r[4] <= 2 * r[2] for r in got)


def test_tree_follows_the_hypergeometric_law():
    """Of 30 and 70 lots, a shard that takes 25 of them draws 7.5 of the first on average, with that law's variance."""
    drawn = np.array([mixing.splitting_tree(np.array([30, 70]), 4, seed)[:, 0] for seed in range(2000)])
    variance = 25 * 0.3 * 0.7 * 75 / 99
    assert np.allclose(drawn.mean(0), 7.5, atol=0.2) and np.allclose(drawn.var(0), variance, rtol=0.12)
    assert (drawn.sum(1) == 30).all()


def test_targets_and_tree():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": 250 * 1 / 3, None: 250 * 2 / 3}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    dealt = mixing.splitting_tree(np.array([7, 0, 100]), 5, 1)
    assert dealt.sum(axis=0).tolist() == [7, 0, 100] and max(dealt.sum(axis=1)) - min(dealt.sum(axis=1)) <= 1


def test_chat_format(spark):
    a = [("user", "hi"), ("assistant", "yo")]
    conversations = {1: a, 2: [*a, ("user", "more")], 3: [*a, ("user", "more")], 4: [("user", None)], 5: [("user", "")], 6: [("user", "yo"), ("assistant", "hi")]}
    rows = [(c, k * 2, r, t) for c, ts in conversations.items() for k, (r, t) in enumerate(ts)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS h1")
    got = {r["conv_id"]: r for r in chat_format.chat_format(df).collect()}
    assert sorted(got) == [2, 4, 5, 6] and got[2]["n_equal"] == 2 and got[2]["n_turns"] == 3
    assert got[2]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert chat_format.chat_format(df.limit(0)).count() == 0


def test_decontaminate(spark):
    r = random.Random(9)
    common = [f"c{k}" for k in range(12)]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choices("abcdefgh", k=6))
    items = [(k, [word() for _ in range(40)]) for k in range(5)]
    edited = [w if r.random() > 0.15 else "edit" for w in items[1][1]]
    texts = {0: items[0][1], 1: edited, 2: [word() for _ in range(300)], 3: items[2][1][:4]}
    rows = [(i, "x, " * 5 + " ".join(w).upper() + ". y" * 5) for i, w in texts.items()] + [(4, None), (5, ""), (6, rows_of(items[0][1])), (6, rows_of(items[0][1])), (None, rows_of(items[0][1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS item_id")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(7, None), (8, ""), (9, " ".join(items[0][1]))], "item_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["score"] == 1) for r in decontaminate.matches(docs, benchmark).collect())
    assert got == [(-1, 0, True), (-1, 9, True), (0, 0, True), (0, 9, True), (1, 1, False), (6, 0, True), (6, 0, True), (6, 9, True), (6, 9, True)]
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), benchmark).count() == 0


def rows_of(words):
    return "-".join(words)


def test_decontaminate_against_all_pairs(spark, monkeypatch):
    """Every document aligned with every item, whole; also with a filter that lets nearly everything pass."""
    r = random.Random(12)
    common = [f"c{k}" for k in range(15)]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choices("abcdefgh", k=4))
    items = [[word() for _ in range(r.choice([2, 12, 30, 45]))] for _ in range(12)]
    texts = []
    for i in range(80):
        inside = [w if r.random() > 0.06 * (i % 8) else word() for w in items[i % 12]]
        if i % 5 == 0 and len(inside) > 4:
            del inside[2]
            inside.insert(7, word())
        texts.append([word() for _ in range(r.randint(0, 60))] + (inside if i % 3 else []) + [word() for _ in range(r.randint(0, 2500 if i == 7 else 60))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    expected = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            score = decontaminate.align(decontaminate.words(" ".join(item)), decontaminate.words(" ".join(t)))[0] / (2 * len(item))
            if score >= 0.5:
                expected[i, k] = score
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.matches(docs, benchmark).collect()}
    # a long item keeps enough seeds; of the items of two words only whole copies are looked for
    long = {key: v for key, v in expected.items() if len(items[key[1]]) > 2}
    assert {key: v for key, v in got.items() if len(items[key[1]]) > 2} == long and len(long) > 20
    assert {key for key in got if len(items[key[1]]) == 2} == {key for key, v in expected.items() if len(items[key[1]]) == 2 and v == 1}
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(decontaminate.Filter, "may_hold", lambda self, h: np.ones(len(h), bool))
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.matches(docs, benchmark).collect()} == got


def test_alignment():
    item = np.arange(1, 11, dtype=np.uint64)

    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return int(h.max())

    r = np.random.default_rng(0)
    for _ in range(60):
        other = r.integers(1, 14, r.integers(1, 25)).astype(np.uint64)
        score, first, last = decontaminate.align(item, other)
        assert score == slow(item, other)
        assert score == 0 or decontaminate.align(item, other[first : last + 1])[0] == score


def labelled(spark, seed=1, n=400):
    r = random.Random(seed)
    good = lambda: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(r.randint(30, 120))).capitalize() + "."
    rows, labels = [], []
    for i in range(n):
        text, quality_label, toxic = good(), 1, 0
        if i % 6 == 0:
            text, quality_label = " ".join(w.upper() + "$$$!!" for w in text.split()), 0
        if i % 5 == 0:
            words = text.split()
            words.insert(len(words) // 2, r.choice(["frobnik", "Fr0bnik", "frоbnik"]))
            text, toxic = " ".join(words), 1
        rows.append((i, text, "en", "s", 0))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, quality_label, toxic))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "abc def", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers(spark):
    docs, labels, known = labelled(spark)
    network = quality.learn(docs, labels, remainder(5) != 0)
    got = {r["doc_id"]: r for r in quality.score(docs, network).collect()}
    held = [(i, q) for i, q, _ in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and quality.score(docs, network).count() == docs.count()
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, labels.limit(0), remainder(5) != 0)).collect()} == {1.0}

    lexicon = toxicity.learn(toxicity.learning_rows(docs, labels, "toxic", remainder(3) != 1))
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    held = [(i, t) for i, _, t in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["predicted"] == t for i, t in held)
    assert toxicity.score(docs, lexicon).count() == docs.count()
    assert {r["score"] for r in toxicity.score(docs, toxicity.Lexicon({})).collect()} == {0.0}


def test_compression_covers_whole_texts():
    r = random.Random(8)
    varied = " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(12_000))  # over 64 KiB
    mixed = varied + " same words again" * 20_000
    assert len(varied) > 1 << 16
    assert quality.features(mixed)[-1] < 0.4 * quality.features(varied)[-1]
    assert quality.features(mixed)[-1] == pytest.approx(len(zlib.compress(mixed.encode(), 1)) / len(mixed), rel=1e-3)


def test_folding_and_exceptions():
    assert toxicity.fold("Id1ot, IDIОT! i​diot 2024") == " idiot idiot idiot 2024 "
    lexicon = toxicity.Lexicon({" trash ": 4.0, " tra": 2.0}, ("trash can",))
    found = lexicon.automaton()
    assert lexicon.features(toxicity.fold("the trash can"), found) == (0.0, 0.0, 0.0, 0.0)
    assert lexicon.features(toxicity.fold("you trash"), found)[2] == 4.0


def test_exceptions_are_learned_from_clean_rows(spark):
    r = random.Random(4)
    filler = lambda: " ".join(r.choices(["river", "stone", "cloud", "green", "table", "walk"], k=12))
    rows = [(i, f"{filler()} you vermin {filler()}", 1) for i in range(60)]
    rows += [(100 + i, f"{filler()} vermin control service {filler()}" if i % 5 == 0 else filler(), 0) for i in range(100)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"), ())
    assert " vermin " in lexicon.weights and "vermin control" in lexicon.exceptions and "you vermin" not in lexicon.exceptions
    docs = spark.createDataFrame([(0, "a vermin control firm"), (1, "you vermin"), (2, "vermin control, you vermin"), (None, None)], "doc_id long, text string")
    assert {x.doc_id: x.matched for x in toxicity.score(docs, lexicon).collect()}[0] == 0
    assert {x.doc_id: x.predicted for x in toxicity.score(docs, lexicon).collect()} == {0: 0, 1: 1, 2: 1, None: 0}
    assert toxicity.phrases(" a b c ", {}) == set() and toxicity.phrases(" b ", {" b ": 1.0}) == set()
    assert toxicity.phrases(" a b c ", {" b ": 1.0}) == {"a b", "b c", "a b c"}


def test_repeated_ids_teach_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(2, "two"), (2, None), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 0), (3, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    learned = toxicity.learning_rows(docs, labels, "toxic", F.lit(True)).collect()
    assert sorted((x.doc_id, x.label) for x in learned) == [(1, 1), (2, 0)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for module in (toxicity, quality):  # a row without id is not held out
        found = module.query(spark, str(tmp_path))
        assert found.count() == 503 and [x.held_out for x in found.where("doc_id is null").collect()] == [False]


def test_stretches_of_a_document():
    n = 10
    assert decontaminate.stretches(np.array([30, 12, 5, 500, -3]), n) == [(0, 32, 3), (20, 30, 1), (490, 30, 1)]
    assert decontaminate.stretches(np.array([0]), 1) == [(0, 2, 1)]


def test_an_item_that_stands_twice_in_a_document(spark):
    item = " ".join(f"q{i}" for i in range(30))
    edited = " ".join(f"q{i}" if i % 6 else "z" for i in range(30))
    gap = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, f"{edited} {gap} {item} {gap} {item}"), (2, f"{gap} {edited}"), (3, gap)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(found) == {1, 2} and found[1].score == 1.0
    # the first of the two whole copies, the edited one before it is worse
    assert (found[1].first_word, found[1].last_word) == (3030, 3059) and found[2].last_word == 3029


def test_empty_tables(spark, nothing):
    assert substring_dedup.substring_dedup(spark, nothing).count() == 0
    assert suffix_dedup.suffix_dedup(spark, nothing).count() == 0
    assert near_dedup.near_duplicates(spark, nothing).count() == 0
    assert class_lm.scores(spark, nothing).count() == 0
    assert mixing.mix(spark, nothing).count() == 0
    assert media.store(nothing).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(nothing, quality.learn(nothing, labels, remainder(5) != 0)).count() == 0
    assert toxicity.score(nothing, toxicity.learn(toxicity.learning_rows(nothing, labels, "toxic", remainder(3) != 1))).count() == 0


def test_queries_on_an_empty_corpus(spark, tmp_path):
    """Every registered query of the subpackage, with its production parameters, on empty tables."""
    from pricewatch_spark.llm import registry

    for name in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {name: q(spark, str(tmp_path)).count() for name, q in registry.QUERIES.items()} == dict.fromkeys(registry.QUERIES, 0)


def test_very_long_texts(spark):
    """Texts of 20,000 words and more, whole, through every operator that reads texts."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(2, 7))) for _ in range(3000)]
    long = [r.choice(words) for _ in range(22_000)]
    near = [w if k % 50 else "edited" for k, w in enumerate(long)]
    other = [r.choice(words) for _ in range(25_000)]
    item = " ".join(other[21_000:21_040])
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(long[20_000:20_060])), (5, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    groups = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark, docs, words=4).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup.substring_dedup(spark, docs).collect()}
    assert cut[4] == (60, 60) and cut[1][1] > 15_000 and cut[3] == (25_000, 0)
    cut = {x["doc_id"]: (x["n_bytes"], x["n_removed"]) for x in suffix_dedup.suffix_dedup(spark, docs).collect()}
    assert cut[4][0] == cut[4][1] and cut[3] == (len(rows[2][1]), 0) and cut[1][1] > 50_000
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = decontaminate.matches(docs, benchmark).collect()
    assert [(x["doc_id"], x["item_id"], x["first_word"], x["score"]) for x in got] == [(3, 9, 21_000, 1.0)]
    mixed = {x["doc_id"]: x["size"] for x in mixing.mix(spark, docs).collect()}
    assert mixed == {i: len(t.split()) for i, t in rows}
    assert {x["n_tokens"] for x in class_lm.scores(spark, docs).collect()} == {22_001, 25_001, 61, 3}
    assert quality.score(docs, None).count() == toxicity.score(docs, toxicity.Lexicon({})).count() == 5
    assert media.facts(media.store(docs)).agg(F.max("n_bytes")).first()[0] == max(len(t) for _, t in rows)


def test_repeated_ids_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "other words here now"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(spark, df).collect())
    assert got == [(False, 0, 0), (False, 4, 0), (False, 50, 50), (False, 50, 50), (True, 50, 50)]
    assert sorted(r["n_removed"] for r in suffix_dedup.suffix_dedup(spark, df, length=100).collect()) == [0, 0, len(long), len(long), len(long)]
    near = near_dedup.near_duplicates(spark, df).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"], r["first"]) for r in near) == [
        (0, 46, 1, False, False), (1, 46, 1, True, True), (1, 46, 1, True, True), (2, 0, 2, True, True), (2, 1, 2, True, True)]
    assert class_lm.scores(spark, df).where(F.col("held_out").isNull()).count() == 0


def test_minimisers_do_not_depend_on_the_text():
    """Equal windows choose equal places in short and long texts, also if hashes differ in few bits."""
    window = np.array([9, 8], np.uint64)
    for after in (0, 10, 5000):
        found = minimisers(np.concatenate([window, np.full(after, 2**60, np.uint64)]), 2)
        assert found[0] == 1
    r = np.random.default_rng(5)
    for w in (1, 2, 3, 7, 16):
        hashes = r.integers(0, 4, 300).astype(np.uint64)
        assert minimisers(hashes, w).tolist() == [i + int(hashes[i : i + w].argmin()) for i in range(301 - w)]


def test_malformed_pages(spark):
    good = '<p>one</p><figure><img src="a.png"><figcaption>cap</figcaption></figure><p>two</p>'
    whole = media.parse_sequence(good)
    for odd in ("<![foo bar]>", "<![", "<!", "<![CDATA[ x ]]>", "<!->", "</", "<![if a]><![endif]>"):
        assert media.parse_sequence(odd + good if odd[-1] == ">" else good + odd)[: len(whole)] == whole
    assert [x["text"] for x in media.parse_sequence("a<![foo bar]>b")] == ["ab"]
    # hidden text goes; what is never closed hides nothing
    assert media.parse_sequence("<noscript><p>x</p></noscript>" + good) == whole
    assert [x["text"] for x in media.parse_sequence("<noscript><p>x</p>" + good) if x["text"]] == ["x", "one", "two"]
    pages = spark.createDataFrame([(1, good), (2, "p<![foo bar]>q"), (3, "<noscript>" + good), (4, None)], "page_id long, html string")
    assert {r["page_id"]: len(r["items"]) for r in media.interleaved(pages).collect()} == {1: 3, 2: 1, 3: 3, 4: 0}
