"""Registered source / advice queries (S01, S06, R01, R03) and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsmith.operators.advise import derive_template, recommend
from tabsmith.operators.steps import apply_steps
from tabsmith.plans.fixtures import LINEITEM_KEY, ORDERS_NULLS_SQL, orders_nulls, table
from tabsmith.plans.sqlgen import RD, R
from tabsmith.session import ensure_checkpoint_dir
from tabsmith.sources.io import preview, read_csv


def _s01(s, sf):
    """Write orders (nulls as the token 'NA', ';' separator) to the shared scratch folder and
    read it back with separator detection, null tokens and type inference."""
    scratch = f"{ensure_checkpoint_dir(s)}/csv-{uuid.uuid4().hex[:8]}"
    o = orders_nulls(s, sf).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    o.na.fill("NA", ["o_orderpriority"]).write.mode("overwrite").option("header", True).option("sep", ";") \
        .option("nullValue", "NA").csv(scratch)
    return read_csv(s, scratch, sep="auto")


def advise_input(s, sf):
    li = table(s, sf, "lineitem")
    return li.select(
        "l_linenumber",
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_discount",
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, F.lit(None))
         .otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_extendedprice", F.lit(1.0).alias("c_one"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("line_ref"))


ADVISE_SQL = """ai AS (SELECT l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_discount,
  CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus,
  l_extendedprice, 1.0 AS c_one, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS line_ref FROM lineitem)"""
ADV_NUM = ["l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "c_one"]
ADV_ALL = ["l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_extendedprice", "c_one",
           "line_ref"]


def _r01(s, sf):
    r = recommend(advise_input(s, sf), target="l_extendedprice")
    return r.select("rule_order", "id", "phase", "step_type", F.array_join("columns", ",").alias("columns"), "options")


def _r03(s, sf):
    li = table(s, sf, "lineitem")
    steps = (derive_template("ratio", {"numerator": "l_extendedprice", "denominator": "l_quantity"}, li.columns)
             + derive_template("sum_diff", {"a": "l_tax", "b": "l_discount"}, li.columns)
             + derive_template("lat_lon_interaction", {"lat": "l_quantity", "lon": "l_tax"}, li.columns))
    out = apply_steps(li, steps)
    names = ["l_extendedprice_per_l_quantity", "l_tax_plus_l_discount", "l_tax_minus_l_discount", "lat_times_lon"]
    return out.select(*LINEITEM_KEY, *[F.round(n, 4).alias(n) for n in names])


QUERIES = {
    "s01_csv_scan": _s01,
    "s06_preview_rows": lambda s, sf: preview(orders_nulls(s, sf), 10, ["o_orderkey"])[0],
    "s06_preview_summary": lambda s, sf: preview(orders_nulls(s, sf), 10, ["o_orderkey"])[1],
    "r01_recommend_steps": _r01,
    "r03_derive_templates": _r03,
}


def _r01_sql() -> str:
    parts = []
    for i, c in enumerate(ADV_ALL):
        if c in ADV_NUM:
            x = f'CAST("{c}" AS DOUBLE)'
            sk = (f"CASE WHEN var_pop({x}) = 0 THEN 0.0 ELSE skewness({x}) END")
            parts.append(f"""SELECT '{c}' AS col, {i} AS position, 'numeric' AS kind, count(*) - count({x}) AS n_missing,
  count(DISTINCT {x}) <= 1 AS is_constant, FALSE AS is_high_card,
  (SELECT count(*) FROM ai, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM ai) b
     WHERE {x} < b.q1 - 1.5 * (b.q3 - b.q1) OR {x} > b.q3 + 1.5 * (b.q3 - b.q1)) AS n_outliers,
  CASE WHEN count({x}) < 3 THEN NULL WHEN abs({sk}) < 0.5 THEN 'normal' WHEN abs({sk}) < 1.0 THEN 'moderate'
       ELSE 'high' END AS severity
FROM ai""")
        else:
            parts.append(f"""SELECT '{c}' AS col, {i} AS position, 'categorical' AS kind, count(*) - count("{c}") AS n_missing,
  FALSE AS is_constant, CAST(count(DISTINCT CAST("{c}" AS VARCHAR)) AS DOUBLE) / count(*) > 0.5 AS is_high_card,
  NULL AS n_outliers, NULL AS severity FROM ai""")
    prof = "\nUNION ALL\n".join(parts)
    y = 'CAST(l_extendedprice AS DOUBLE)'
    tsk = f"CASE WHEN var_pop({y}) = 0 THEN 0.0 ELSE skewness({y}) END"
    return f"""WITH {ADVISE_SQL},
prof AS ({prof}),
tgt AS (SELECT coalesce(abs({tsk}) >= 0.5, FALSE) AS ok FROM ai),
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ai)) AS n FROM ai),
agg AS (SELECT
  string_agg(col, ',' ORDER BY position) FILTER (WHERE kind = 'numeric' AND is_constant) AS c0,
  string_agg(col, ',' ORDER BY position) FILTER (WHERE n_missing > 0 AND kind = 'numeric') AS c2,
  string_agg(col, ',' ORDER BY position) FILTER (WHERE n_missing > 0 AND kind <> 'numeric') AS c3,
  string_agg(col, ',' ORDER BY position) FILTER (WHERE coalesce(n_outliers, 0) > 0 AND kind = 'numeric') AS c4,
  string_agg(col, ',' ORDER BY position) FILTER (WHERE kind = 'numeric' AND NOT is_constant
      AND (coalesce(severity, 'normal') <> 'normal' OR (col = 'l_extendedprice' AND (SELECT ok FROM tgt)))) AS c5,
  string_agg(col, ',' ORDER BY position) FILTER (WHERE is_high_card) AS c6
  FROM prof)
SELECT * FROM (
  SELECT 0 AS rule_order, 'drop-constants' AS id, 'pre_split' AS phase, 'drop_columns' AS step_type, c0 AS columns, '{{}}' AS options FROM agg
  UNION ALL SELECT 1, 'drop-duplicates', 'pre_split', 'drop_duplicates', CASE WHEN (SELECT n FROM dup) > 0 THEN '' END, '{{"keep": "first"}}'
  UNION ALL SELECT 2, 'impute-numeric', 'post_split', 'impute', c2, '{{"strategy": "median"}}' FROM agg
  UNION ALL SELECT 3, 'impute-categorical', 'post_split', 'impute', c3, '{{"strategy": "mode"}}' FROM agg
  UNION ALL SELECT 4, 'clip-outliers', 'post_split', 'clip_outliers', c4, '{{"method": "iqr"}}' FROM agg
  UNION ALL SELECT 5, 'fix-skewness', 'post_split', 'fix_skewness', c5, '{{"method": "auto", "threshold": 0.5}}' FROM agg
  UNION ALL SELECT 6, 'frequency-encode', 'post_split', 'frequency_encode', c6, '{{"normalize": true}}' FROM agg)
WHERE columns IS NOT NULL AND (columns <> '' OR id = 'drop-duplicates')"""


ORACLE = {
    "s01_csv_scan": "WITH " + ORDERS_NULLS_SQL + """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority FROM orders_nulls""",
    "s06_preview_rows": "WITH " + ORDERS_NULLS_SQL + "\nSELECT * FROM orders_nulls ORDER BY o_orderkey LIMIT 10",
    "s06_preview_summary": "WITH " + ORDERS_NULLS_SQL + "\n" + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, {n} AS is_numeric,
  CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(6 AS BIGINT) AS n_cols FROM orders_nulls"""
        for c, t, n in [("o_orderkey", "bigint", "TRUE"), ("o_custkey", "bigint", "TRUE"),
                        ("o_orderstatus", "string", "FALSE"), ("o_totalprice", "double", "TRUE"),
                        ("o_orderdate", "timestamp_ntz", "FALSE"), ("o_orderpriority", "string", "FALSE")]),
    "r01_recommend_steps": _r01_sql(),
    "r03_derive_templates": f"""SELECT {', '.join(LINEITEM_KEY)},
  {RD('CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END')} AS l_extendedprice_per_l_quantity,
  {R('l_tax + l_discount')} AS l_tax_plus_l_discount, {R('l_tax - l_discount')} AS l_tax_minus_l_discount,
  {R('l_quantity * l_tax')} AS lat_times_lon FROM lineitem""",
}
