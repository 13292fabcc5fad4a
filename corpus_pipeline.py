"""A corpus pipeline of five stages, each one of the operators of pricewatch_spark.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns the mix, with the cleaned texts.  ``run`` writes every stage as Parquet in
the shared folder and reads it back as the next one's input; ``write_corpus`` writes the result by
shard, in the order in which each shard shuffles its documents.

Every row of a stage's input is decided by itself, whatever its doc_id: rows with a null doc_id are
scored, compared and cleaned like others.  Of a near-duplicate group the smallest doc_id stays,
repeated rows of it once; the stage compares shingles of five words.  Null and empty texts have no
copies, passages or leaks and stay unless the classifier rejects them; very long texts are taken
whole; an empty table gives empty stages.  Further columns of documents go through unchanged,
whatever their names: stages carry a row as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch_spark.llm import decontaminate, mixing, near_dedup, quality, substring_dedup
from pricewatch_spark.llm.common import Scratch, remainder, table


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash and all columns as one struct."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", F.unhex(F.md5(text.cast("binary"))).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the features are computed once, beside the rows."""
    rows = quality.feature_table(whole_rows(docs), Scratch(spark, "quality"), "row")
    network = quality.fit(rows, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return quality.scored(rows, network, "row").where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id."""
    found = near_dedup.near_duplicates(spark, docs).where("first")
    marks = found.groupBy("doc_id", "text_hash").agg((F.max("n_shingles") == 0).alias("empty"), F.count(F.lit(1)).alias("times"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash"))
    kept = whole_rows(docs).alias("d").join(marks.alias("m"), same).select("d.*", (F.col("m.empty") | (F.col("m.times") == 1)).alias("alone"))
    repeated = kept.where("not alone").dropDuplicates(["doc_id", "text_hash"])
    return kept.where("alone").unionByName(repeated).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by repeated windows go, with the blanks after them; texts that lose nothing
    stay as they are, others whose words are all gone are left out."""
    cut = substring_dedup.substring_dedup(spark, whole_rows(docs), keep_text=True, keep=["row"])
    lost = F.col("n_removed") > 0
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [F.when(lost, changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.where(~lost | (F.col("n_removed") < F.col("n_words"))).select(columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also an edited one, go."""
    leaks = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("text_hash").distinct()
    return whole_rows(docs).join(leaks, "text_hash", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, pick, drawn (the copies of the text with their
    shards and places), taken, text, others (the further columns of documents)."""
    return mixing.with_texts(mixing.mix(spark, docs), docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The classifier, the registers and the alignment can't be said in SQL.
ORACLE_SQL = None


def write_corpus(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The corpus: a folder a shard, with a row for each copy that it draws, in the order of place."""
    mixing.write_shards(run(spark, sf_dir), path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
