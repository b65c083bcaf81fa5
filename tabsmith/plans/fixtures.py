"""Inputs of the registered queries: the driver tables plus derived views whose expression
is written identically for Spark and for the SQL oracle (nulls are injected by key, on every
row of the whole table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_NULLS_SQL = """orders_nulls AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
# unique at every scale factor (the first four columns alone repeat at sf0.001)
LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
SPLIT_KEY4 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def preds_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression predictions fixture: y = l_extendedprice, yhat = l_quantity * 1500 and a
    hash split (about 20 % test)."""
    li = table(spark, sf_dir, "lineitem")
    h = F.md5(F.concat_ws("~", *[F.col(c).cast("string") for c in SPLIT_KEY4], F.lit("7")))
    return li.select(*LINEITEM_KEY, F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("yhat"),
                     F.when(F.substring(h, 1, 1).isin("0", "1", "2"), "test").otherwise("train").alias("split"))


PREDS_REG_SQL = """preds_reg AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice AS y, l_quantity * 1500 AS yhat,
         CASE WHEN substring(md5(concat_ws('~', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
              CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '7')), 1, 1) IN ('0','1','2')
              THEN 'test' ELSE 'train' END AS split
  FROM lineitem)"""


def preds_clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification predictions fixture: y = l_returnflag, yhat from l_linestatus and l_quantity."""
    li = table(spark, sf_dir, "lineitem")
    yhat = (F.when(F.col("l_linestatus") == "F", F.when(F.col("l_quantity") > 25, "R").otherwise("A"))
             .otherwise("N"))
    return li.select(*LINEITEM_KEY, F.col("l_returnflag").alias("y"), yhat.alias("yhat"))


PREDS_CLF_SQL = """preds_clf AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag AS y,
         CASE WHEN l_linestatus = 'F' THEN (CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END) ELSE 'N' END AS yhat
  FROM lineitem)"""


def preds_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary scores fixture: y = labels.quality, score from the document length and toxicity."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    score = F.round(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.log1p(F.col("n_chars").cast("double")) / 4.0)
                    - F.col("toxic") * 0.25, 2)
    return j.select("doc_id", F.col("quality").alias("y"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


PREDS_BIN_SQL = """preds_bin AS (
  SELECT l.doc_id, l.quality AS y,
         greatest(0.0, least(1.0, round(1.0 - 1.0 / (1.0 + ln(1 + CAST(d.n_chars AS DOUBLE)) / 4.0)
                                        - l.toxic * 0.25, 2))) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def lineitem_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of lineitem, two of them with nulls injected by key."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")),
        "l_returnflag": F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 != 0, F.col("l_returnflag")),
    })


LINEITEM_NULLS_SQL = """lineitem_nulls AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity,
                    CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN l_returnflag END AS l_returnflag)
  FROM lineitem)"""
