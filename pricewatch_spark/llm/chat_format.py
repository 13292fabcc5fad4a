"""Chat formatting: collapse of cumulative snapshots, then rendering.

A logged conversation that is a prefix of a longer one (same roles and texts, turn by turn) adds
nothing; of equal ones the smallest id stays.  A rolling hash of every turn prefix identifies
them: position-dependent turn hashes are summed along the conversation, so the hash of each
prefix is a running sum.  Three lanes of 40 bits make 120 bits, so that among 10**12 prefixes a false
match has a chance below 1e-11; a lane of 40 bits sums up 2**23 turns without overflow.

Defined results: rows without conv_id belong to no conversation and are left out; null role or
text differ from the empty string while comparing and render as empty; turns are ordered by
(turn, role, text), nulls first, so ties make no difference; repeated rows are turns of their own;
gaps in turn do not matter; empty and very long texts are turns like others; an empty table gives
no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewatch_spark.llm.common import table

NAME = "op1_chat_format"
_LANE = (1 << 40) - 1
_HASHES = ["h1", "h2", "h3"]


def turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, pos (1, 2, ...), role, text."""
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", "role", "text")
        .select("conv_id", F.row_number().over(order).alias("pos"), "turn", "role", "text")
    )


def prefix_hashes(of_turns: DataFrame) -> DataFrame:
    """conv_id, pos, h1, h2, h3 (hash of the first pos turns), last (whether the conversation ends there)."""
    fields = [F.col("pos"), F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text")]
    whole = Window.partitionBy("conv_id").orderBy("pos")
    lanes = of_turns.select(
        "conv_id",
        "pos",
        *(F.xxhash64(F.lit(k), *fields).bitwiseAND(F.lit(_LANE)).alias(h) for k, h in enumerate(_HASHES, 1)),
    )
    return lanes.select(
        "conv_id",
        "pos",
        *(F.sum(h).over(whole).alias(h) for h in _HASHES),
        F.lead("pos").over(whole).isNull().alias("last"),
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of a longer one; n_equal copies of each."""
    full = (
        hashes.where("last")
        .groupBy(*_HASHES, F.col("pos").alias("n_turns"))
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    )
    inner = hashes.where(~F.col("last")).select(*_HASHES, F.col("pos").alias("n_turns")).distinct()
    return full.join(inner, [*_HASHES, "n_turns"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(of_turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal, text: the kept conversations in the ChatML layout."""
    line = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    return (
        of_turns.join(kept, "conv_id")
        .groupBy("conv_id", "n_turns", "n_equal")
        .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select(
            "conv_id",
            F.col("n_turns").cast("long").alias("n_turns"),
            "n_equal",
            F.array_join(F.col("lines.line"), "").alias("text"),
        )
    )


def chat_format(conversations: DataFrame) -> DataFrame:
    of_turns = turns(conversations)
    return render(of_turns, maximal(prefix_hashes(of_turns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         role, text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS txt
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT to_json(l[1:k]) AS j FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
f AS (SELECT to_json(l) AS j, len(l) AS n, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.n AS BIGINT) AS n_turns, CAST(f.n_equal AS BIGINT) AS n_equal, c.txt AS text
FROM f JOIN c USING (conv_id) WHERE f.j NOT IN (SELECT j FROM p)
"""
