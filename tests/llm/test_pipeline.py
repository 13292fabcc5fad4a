import collections
import random

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            assert after.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= docs.count()
        docs, before = after, docs
    assert docs.count() == before.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and got.where("taken > 2 * size").count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "predicted", "n_words", "n_removed", "kept_sha256", "kept_text", "text_hash", "row", "size", "item_id", "component_id", "first", "held_out")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: near and repeated documents, a shared passage, a leak, nulls, empty texts, columns with clashing names."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    passage, item = text(60), text(45)
    rows = {i: text(r.randint(80, 200)) for i in range(120)}
    for i in range(0, 120, 9):
        rows[i] = " ".join(w.upper() + "$$!!" for w in rows[i].split())
    rows[121] = rows[1].replace(rows[1].split()[40], "edited", 1)  # a near copy
    rows[122] = rows[2]
    for i in (3, 5):
        rows[i] = f"{text(50)}\n{passage}\n{text(50)}"
    rows[7] = f"{text(60)} {item} {text(60)}"
    edited = " ".join(w if k % 11 else "edit" for k, w in enumerate(item.split()))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows.items()]
    docs += [docs[4], docs[4], (None, rows[8], "en", "s1", 0), (None, f"{text(70)} {edited}", None, None, None), (130, None, None, None, None), (131, "", "en", "s0", 0), (None, None, None, None, None)]
    labels = [(i, int(i % 9 > 0), 0) for i in range(120) if i % 4] + [(None, 1, 1), (10_000, 1, None)]
    root = tmp_path_factory.mktemp("small")
    more = spark.createDataFrame(docs, DOCS).selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHES))
    more.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), passage, item


def test_stages_on_odd_rows(spark, small, tmp_path):
    root, passage, item = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns, name
        assert docs.where(" or ".join(f"{c} <> '{c}'" for c in CLASHES)).count() == 0, name
        kept[name] = docs.select("doc_id", "text").collect()
    ids = {name: collections.Counter(r["doc_id"] for r in rows) for name, rows in kept.items()}
    assert not {i for i in range(0, 120, 9)} & set(ids["quality classifier"]) and ids["quality classifier"][1] == 1 and ids["quality classifier"][4] == 3
    good, near = ids["quality classifier"], ids["near dedup"]
    assert near[1] == near[2] == near[4] == 1 and not {121, 122} & set(near) and all(near[i] == good[i] for i in (130, 131))
    # of the rows without id, the one that is a copy goes, others stay
    assert 0 <= near[None] == good[None] - 1
    texts = {r["doc_id"]: r["text"] for r in kept["substring dedup"]}
    assert all(passage not in texts[i] and texts[i].count("\n") == 1 for i in (3, 5)) and texts[1] == [r["text"] for r in kept["near dedup"] if r["doc_id"] == 1][0]
    assert not any(item in (r["text"] or "") for r in kept["decontamination"]) and 7 not in ids["decontamination"]
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, root)
    assert mix.count() == docs.count() and mix.where("doc_id is null").count() == ids["decontamination"][None]


def test_the_corpus_holds_the_cleaned_texts(spark, small, tmp_path):
    """Every copy that the mix draws is in its shard, in the order of place, with the text of the stage before."""
    root, *_ = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    mixed = corpus_pipeline.run(spark, root)
    rows = mixed.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == before
    assert {r["others"]["lang"] for r in rows if r["doc_id"] is not None} <= {"en", None} and all(r["others"]["item_id"] == "item_id" for r in rows)
    drawn = collections.Counter((x["shard"], x["place"], r["doc_id"], r["text"]) for r in rows for x in r["drawn"])
    assert sum(drawn.values()) > len(rows)
    corpus_pipeline.write_corpus(spark, root, f"{tmp_path}/corpus")
    read = spark.read.parquet(f"{tmp_path}/corpus")
    assert collections.Counter((r["shard"], r["place"], r["doc_id"], r["text"]) for r in read.collect()) == drawn
    for folder in tmp_path.glob("corpus/shard=*"):
        places = [r["place"] for r in spark.read.parquet(str(folder)).coalesce(1).collect()]
        assert places == sorted(places)


def test_empty_documents(spark, small):
    root, *_ = small
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, root).count() == 0, name


@pytest.mark.parametrize("name", ["chat_format"])
def test_oracle(spark, name):
    from oracle import oracle_rows, rows_of

    from pricewatch_spark.llm import chat_format

    assert rows_of(chat_format.query(spark, SF)) == oracle_rows(chat_format.ORACLE_SQL, SF)
