"""The driver's tables read as the data model: one DataFrame function and one SQL text a table.

Both sides derive the same rows; every query and its SQL twin start from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WITH = {
    "sources": """SELECT s_suppkey AS source_id, s_name AS name, s_acctbal >= 0 AS is_active,
      CASE s_nationkey % 4 WHEN 0 THEN 'B2B_WHOLESALE' WHEN 1 THEN 'B2C_RETAIL' WHEN 2 THEN 'MARKETPLACE' END AS business_type,
      CASE s_suppkey % 4 WHEN 0 THEN 'shopify' WHEN 1 THEN 'bs4_woocommerce' WHEN 2 THEN 'bs4_jumpseller' ELSE 'playwright_b2b' END AS engine_type,
      'CLP' AS currency, 50 AS reliability_score FROM supplier""",
    "products": """SELECT p_partkey AS product_id, concat('a', lpad(CAST(p_partkey + 1 AS STRING), 8, '0')) AS product_code, p_brand AS brand, p_name AS product_name,
      CASE WHEN p_partkey % 5 = 0 THEN 'Intense' END AS variant,
      CASE p_partkey % 6 WHEN 0 THEN 'EDP' WHEN 1 THEN 'EDT' WHEN 2 THEN 'PARFUM' WHEN 3 THEN 'COLOGNE' WHEN 4 THEN 'BODY_MIST' END AS fragrance_type,
      CASE WHEN p_size % 7 <> 0 THEN p_size * 10 END AS volume_ml,
      CASE p_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'UNISEX' END AS gender,
      CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey AS STRING), 13, '7') END AS ean_13,
      CAST((p_partkey % 5) * 0.25 AS DECIMAL(3,2)) AS confidence FROM part""",
    "observations": """SELECT l_suppkey AS source_id, l_partkey AS product_id, l_shipdate AS seen_at, l_orderkey, l_linenumber,
      CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
      CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INT) END AS stock FROM lineitem""",
    "history": """SELECT source_id, product_id, seen_at, l_orderkey, l_linenumber, price, stock,
      CASE WHEN stock IS NULL THEN 'UNKNOWN' WHEN stock > 0 THEN 'AVAILABLE_IN_STOCK' ELSE 'OUT_OF_STOCK' END AS availability FROM observations""",
    "listings": """SELECT source_id, product_id, price AS current_price, stock AS current_stock, availability, seen_at AS last_seen_at,
      CASE WHEN stock IS NULL THEN 'UNKNOWN' WHEN l_linenumber % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS stock_confidence,
      CASE WHEN product_id % 11 <> 0 THEN concat('https://shop/', CAST(product_id AS STRING)) END AS url,
      CASE WHEN product_id % 13 <> 0 THEN concat('https://img/', CAST(product_id AS STRING)) END AS image_url
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id, product_id ORDER BY seen_at DESC, l_orderkey DESC, l_linenumber DESC) AS back FROM history) WHERE back = 1""",
    "logs": """SELECT event_id AS log_id, user_id AS source_id, ts AS started_at, CAST(floor(value) AS INT) AS records,
      CASE event_id % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'EMPTY' ELSE 'RUNNING' END AS status FROM events""",
    "queue": """SELECT o_orderkey AS job_id, o_custkey % (SELECT count(*) FROM supplier) AS source_id, CAST(1 + o_orderkey % 10 AS INT) AS priority, o_orderdate AS scheduled_at, 0 AS retries,
      CASE WHEN o_orderdate >= TIMESTAMP '1998-05-25' AND o_orderdate < TIMESTAMP '1998-06-08' AND o_orderstatus = 'O' THEN 'PENDING'
        WHEN o_orderdate >= TIMESTAMP '1998-05-25' AND o_orderdate < TIMESTAMP '1998-06-08' AND o_orderstatus = 'P' THEN 'RUNNING'
        WHEN o_orderstatus = 'O' THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM orders""",
    "tiers": """SELECT o_custkey AS customer, o_orderpriority AS tier_name, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderdate AS valid_from,
      lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders""",
    "titles": """SELECT p_partkey AS row_id,
      CASE p_partkey % 6 WHEN 0 THEN 'Dolce & Gabbana' WHEN 1 THEN 'Tom Ford' WHEN 2 THEN 'Dior' WHEN 3 THEN 'Paco Rabanne' WHEN 4 THEN 'Xerjoff' ELSE 'Zzyzx' END AS t_brand,
      concat('Item', CAST(p_partkey AS STRING)) AS t_name,
      CASE p_partkey % 7 WHEN 0 THEN 'Eau de Parfum' WHEN 1 THEN 'EDT' WHEN 2 THEN 'Extrait de Parfum' WHEN 3 THEN 'Cologne' WHEN 4 THEN 'body mist' ELSE '' END AS t_type,
      CASE WHEN p_size % 3 <> 0 THEN concat(CAST(p_size AS STRING), ' ML') ELSE '' END AS t_volume,
      CASE p_partkey % 4 WHEN 0 THEN 'Men' WHEN 1 THEN 'Mujer' WHEN 2 THEN 'Unisex' ELSE '' END AS t_gender,
      CASE WHEN p_partkey % 5 = 0 THEN 'Intense' ELSE '' END AS t_variant,
      CASE WHEN p_partkey % 9 = 0 THEN 'creed boutique' END AS vendor, p_size FROM part""",
}
_NEEDS = {"history": ["observations"], "listings": ["observations", "history"]}
_TABLES = {"sources": ["supplier"], "products": ["part"], "observations": ["lineitem"], "logs": ["events"], "queue": ["orders", "supplier"], "tiers": ["orders"], "titles": ["part"]}


def needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [x for x in (*_NEEDS.get(name, []), name) if x not in out]
    return out


def ctes(*names: str) -> str:
    """WITH text for the SQL twins."""
    return "WITH " + ",\n".join(f"{n} AS ({WITH[n]})" for n in needed(list(names)))


class Model:
    """The tables of the data model over a folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in WITH:
            raise AttributeError(name)
        frames = {t: self.raw(t) for t in {t for n in needed([name]) for t in _TABLES.get(n, [])}}
        done: dict[str, DataFrame] = {}
        for n in needed([name]):
            wanted = {k: v for k, v in {**frames, **done}.items() if k in WITH[n]}
            text = WITH[n]
            for k in sorted(wanted, key=len, reverse=True):
                text = text.replace(f"FROM {k}", "FROM {" + k + "}")
            done[n] = self.spark.sql(text, **{k: v for k, v in wanted.items() if "{" + k + "}" in text})
        return done[name]

    @property
    def chains(self) -> DataFrame:
        """Raw listings with long chains of states: 20 listings a source, coarse prices."""
        line = self.raw("lineitem")
        state = "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN '0' ELSE '7' END"
        return line.select(
            F.lit("run").alias("run_id"),
            F.col("l_suppkey").alias("source_id"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("pos"),
            F.col("l_shipdate").alias("scraped_at"),
            F.expr("concat('Item ', l_partkey % 20, ' no ', l_linenumber)").alias("raw_title"),
            (F.floor(F.col("l_extendedprice") / 20000) * 1000).cast("string").alias("price"),
            F.expr(state).alias("stock"),
            F.lit(None).cast("string").alias("inventory_quantity"),
            F.lit(None).cast("string").alias("stock_text"),
            F.lit(True).alias("available"),
            (F.col("l_partkey") % 20).cast("string").alias("sku"),
            F.expr("CASE WHEN l_linenumber % 3 > 0 THEN concat('u', l_orderkey) ELSE '' END").alias("url"),
            F.expr("CASE WHEN l_linenumber % 4 > 1 THEN concat('i', l_orderkey) END").alias("image_url"),
            F.expr("CAST(l_linenumber % 4 * 8 AS STRING)").alias("moq"),
            F.expr("CASE WHEN l_linenumber % 5 = 2 THEN array(named_struct('qty', l_linenumber * 10, 'price', CAST(l_orderkey % 50 AS DECIMAL(12,2)))) END").alias("bulk_tiers"),
        )
