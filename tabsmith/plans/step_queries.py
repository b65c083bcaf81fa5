"""Registered transform-step queries (T01–T22) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators.steps import apply_steps
from tabsmith.plans.fixtures import (
    LINEITEM_KEY,
    ORDERS_NULLS_SQL,
    orders_nulls,
    table,
)
from tabsmith.plans.sqlgen import R, md5_key

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ON_CTE = "WITH " + ORDERS_NULLS_SQL + "\n"


def _li(s, sf):
    return table(s, sf, "lineitem")


def _r(df, key, cols, d=4):
    """Key columns plus rounded value columns (the comparison edge)."""
    return df.select(*key, *[F.round(F.col(c).cast("double"), d).alias(c) for c in cols])


def mixed_strings(s, sf):
    o = table(s, sf, "orders")
    m = F.col("o_orderkey") % 7
    v = (F.when(m == 0, F.lit(None)).when(m == 1, "x").when(m == 2, "").when(m == 3, " 3.5").when(m == 4, "-1e3")
          .when(m == 5, "2.5")
          .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return o.select("o_orderkey", v.alias("v"))


MIXED_SQL = """mixed AS (SELECT o_orderkey,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN ' 3.5' WHEN 4 THEN '-1e3'
       WHEN 5 THEN '2.5' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS v FROM orders)"""


def date_strings(s, sf):
    o = table(s, sf, "orders")
    m = F.col("o_orderkey") % 4
    d = (F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 1, "2024-02-29 23:59:00")
          .when(m == 2, "bad").otherwise(F.lit(None)))
    return o.select("o_orderkey", d.alias("d"))


DATES_SQL = """ds AS (SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2024-02-29 23:59:00'
       WHEN 2 THEN 'bad' ELSE NULL END AS d FROM orders)"""

DT_PARTS = ["year", "month", "day", "hour", "minute", "dow", "doy", "week"]


def _dt_sql(ts: str, prefix: str, typ: str = "INTEGER") -> str:
    f = {"year": f"year({ts})", "month": f"month({ts})", "day": f"day({ts})", "hour": f"hour({ts})",
         "minute": f"minute({ts})", "dow": f"isodow({ts}) - 1", "doy": f"dayofyear({ts})", "week": f"weekofyear({ts})"}
    return ", ".join(f"CAST({f[p]} AS {typ}) AS {prefix}_{p}" for p in DT_PARTS)


PIPE_STEPS = [
    {"type": "impute", "columns": ["o_totalprice"], "strategy": "median"},
    {"type": "clip_outliers", "columns": ["o_totalprice"], "method": "iqr"},
    {"type": "scale", "columns": ["o_totalprice"], "method": "standard"},
    {"type": "one_hot_encode", "columns": ["o_orderstatus"]},
    {"type": "frequency_encode", "columns": ["o_orderpriority"], "normalize": True},
    {"type": "drop_columns", "columns": ["o_orderdate", "o_custkey"]},
]

QUERIES = {
    "t01_drop_columns": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "drop_columns", "columns": ["l_tax", "l_discount", "l_shipdate", "no_such_column"]}]),
    "t02_rename_columns": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "rename_columns", "mapping": {"l_quantity": "qty", "l_tax": "tax_rate", "missing": "x",
                                               "l_discount": "  "}}]),
    "t03a_impute_mean": lambda s, sf: _r(apply_steps(orders_nulls(s, sf), [
        {"type": "impute", "columns": ["o_totalprice"], "strategy": "mean"}]), ["o_orderkey"], ["o_totalprice"]),
    "t03b_impute_median": lambda s, sf: _r(apply_steps(orders_nulls(s, sf), [
        {"type": "impute", "columns": ["o_totalprice"], "strategy": "median"}]), ["o_orderkey"], ["o_totalprice"]),
    "t03c_impute_mode": lambda s, sf: apply_steps(orders_nulls(s, sf), [
        {"type": "impute", "columns": ["o_orderpriority"], "strategy": "mode"}]).select("o_orderkey", "o_orderpriority"),
    "t03d_impute_zero": lambda s, sf: apply_steps(orders_nulls(s, sf), [
        {"type": "impute", "columns": ["o_totalprice"], "strategy": "zero"}]).select("o_orderkey", "o_totalprice"),
    "t04_one_hot_encode": lambda s, sf: apply_steps(table(s, sf, "customer"), [
        {"type": "one_hot_encode", "columns": ["c_mktsegment"]}]).drop("c_name", "c_acctbal"),
    "t05_label_encode": lambda s, sf: apply_steps(table(s, sf, "part"), [
        {"type": "label_encode", "columns": ["p_brand", "p_type"]}]).select("p_partkey", "p_brand", "p_type"),
    "t05_label_encode_nulls": lambda s, sf: apply_steps(orders_nulls(s, sf), [
        {"type": "label_encode", "columns": ["o_orderpriority"]}]).select("o_orderkey", "o_orderpriority"),
    "t06a_clip_iqr": lambda s, sf: _r(apply_steps(table(s, sf, "events"), [
        {"type": "clip_outliers", "columns": ["value"], "method": "iqr"}]), ["event_id"], ["value"]),
    "t06b_clip_zscore": lambda s, sf: _r(apply_steps(table(s, sf, "events"), [
        {"type": "clip_outliers", "columns": ["value"], "method": "zscore"}]), ["event_id"], ["value"]),
    "t06c_clip_percentile": lambda s, sf: _r(apply_steps(orders_nulls(s, sf), [
        {"type": "clip_outliers", "columns": ["o_totalprice"], "method": "percentile", "p_low": 0.05,
         "p_high": 0.95}]), ["o_orderkey"], ["o_totalprice"]),
    "t07a_scale_standard": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "scale", "columns": ["l_quantity", "l_extendedprice", "l_discount"], "method": "standard"}]),
        LINEITEM_KEY, ["l_quantity", "l_extendedprice", "l_discount"]),
    "t07b_scale_minmax": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "scale", "columns": ["l_quantity", "l_extendedprice", "l_discount"], "method": "minmax"}]),
        LINEITEM_KEY, ["l_quantity", "l_extendedprice", "l_discount"]),
    "t07c_scale_robust": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "scale", "columns": ["l_quantity", "l_extendedprice", "l_discount"], "method": "robust"}]),
        LINEITEM_KEY, ["l_quantity", "l_extendedprice", "l_discount"]),
    "t08_math_transform": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "math_transform", "columns": ["l_extendedprice"], "method": "log1p"},
        {"type": "math_transform", "columns": ["l_discount"], "method": "reciprocal"},
        {"type": "math_transform", "columns": ["l_tax"], "method": "sqrt"},
        {"type": "math_transform", "columns": ["l_quantity"], "method": "square", "output_mode": "new_columns"},
        {"type": "math_transform", "columns": ["l_quantity"], "method": "abs", "output_mode": "new_columns"},
    ]), LINEITEM_KEY, ["l_extendedprice", "l_discount", "l_tax", "sq_l_quantity", "abs_l_quantity"]),
    "t09c_fix_skewness_log1p": lambda s, sf: apply_steps(table(s, sf, "orders").select("o_orderkey", "o_totalprice"), [
        {"type": "fix_skewness", "columns": ["o_totalprice"], "method": "log1p", "threshold": 0.0}])
    .select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice")),
    "t09c_fix_skewness_sqrt": lambda s, sf: apply_steps(table(s, sf, "orders").select("o_orderkey", "o_totalprice"), [
        {"type": "fix_skewness", "columns": ["o_totalprice"], "method": "sqrt", "threshold": 0.0}])
    .select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice")),
    "t09_fix_skewness_auto": lambda s, sf: _r(apply_steps(table(s, sf, "events"), [
        {"type": "fix_skewness", "columns": ["value", "user_id"], "method": "auto"}]), ["event_id"],
        ["value", "user_id"]),
    "t10a_bin_equal_width": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "bin_numeric", "columns": ["l_discount"], "n_bins": 10},
        {"type": "bin_numeric", "columns": ["l_quantity"], "n_bins": 5}]).select(
        *LINEITEM_KEY, "l_discount_bin", "l_quantity_bin"),
    "t10b_bin_quantile": lambda s, sf: apply_steps(table(s, sf, "events"), [
        {"type": "bin_numeric", "columns": ["value"], "n_bins": 4, "strategy": "quantile"}]).select(
        "event_id", "value_bin"),
    "t11a_drop_duplicates_first": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "drop_duplicates", "columns": ["l_orderkey", "l_linenumber"], "keep": "first",
         "order_key": LINEITEM_KEY}]),
    "t11a_drop_duplicates_last": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "drop_duplicates", "columns": ["l_orderkey", "l_linenumber"], "keep": "last",
         "order_key": LINEITEM_KEY}]),
    "t11b_drop_duplicates_none": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "drop_duplicates", "columns": ["l_orderkey", "l_linenumber"], "keep": "none"}]),
    "t11c_drop_duplicates_rows": lambda s, sf: apply_steps(
        _li(s, sf).select("l_returnflag", "l_linestatus", "l_quantity"), [{"type": "drop_duplicates"}]),
    "t12_drop_nulls_any": lambda s, sf: apply_steps(orders_nulls(s, sf), [{"type": "drop_nulls", "how": "any"}]),
    "t12_drop_nulls_all": lambda s, sf: apply_steps(orders_nulls(s, sf), [
        {"type": "drop_nulls", "columns": ["o_totalprice", "o_orderpriority"], "how": "all"}]),
    "t13_frequency_encode": lambda s, sf: apply_steps(_li(s, sf), [
        {"type": "frequency_encode", "columns": ["l_returnflag", "l_shipdate"]}]).select(
        *LINEITEM_KEY, F.round("l_returnflag_freq", 6).alias("l_returnflag_freq"),
        F.round("l_shipdate_freq", 6).alias("l_shipdate_freq")),
    "t13_frequency_encode_counts": lambda s, sf: apply_steps(orders_nulls(s, sf), [
        {"type": "frequency_encode", "columns": ["o_orderpriority", "o_totalprice"], "normalize": False}]).select(
        "o_orderkey", F.col("o_orderpriority_freq").cast("double").alias("o_orderpriority_freq"),
        F.col("o_totalprice_freq").cast("double").alias("o_totalprice_freq")),
    "t14a_cast_float": lambda s, sf: apply_steps(mixed_strings(s, sf), [
        {"type": "cast_dtype", "columns": ["v"], "dtype": "float"}]),
    "t14b_cast_int": lambda s, sf: apply_steps(mixed_strings(s, sf), [
        {"type": "cast_dtype", "columns": ["v"], "dtype": "int"}]).select("o_orderkey", F.col("v").cast("double").alias("v")),
    "t14c_cast_str": lambda s, sf: apply_steps(table(s, sf, "orders").select("o_orderkey", "o_custkey"), [
        {"type": "cast_dtype", "columns": ["o_custkey"], "dtype": "str"}]),
    "t15_polynomial_features": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "polynomial_features", "columns": ["l_quantity", "l_discount"], "degree": 2}]), LINEITEM_KEY,
        ["poly_l_quantity", "poly_l_discount", "poly_l_quantitypow2", "poly_l_quantity_l_discount",
         "poly_l_discountpow2"]),
    "t15_polynomial_interactions": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "polynomial_features", "columns": ["l_quantity", "l_discount", "l_tax"], "degree": 3,
         "interaction_only": True, "include_bias": True}]), LINEITEM_KEY,
        ["poly_1", "poly_l_quantity", "poly_l_discount", "poly_l_tax", "poly_l_quantity_l_discount",
         "poly_l_quantity_l_tax", "poly_l_discount_l_tax", "poly_l_quantity_l_discount_l_tax"]),
    "t16_extract_datetime": lambda s, sf: apply_steps(table(s, sf, "orders"), [
        {"type": "extract_datetime", "columns": ["o_orderdate"], "parts": DT_PARTS}]).select(
        "o_orderkey", *[f"o_orderdate_{p}" for p in DT_PARTS]),
    "t16_extract_datetime_strings": lambda s, sf: apply_steps(date_strings(s, sf), [
        {"type": "extract_datetime", "columns": ["d"], "parts": DT_PARTS}]).select(
        "o_orderkey", *[F.col(f"d_{p}").cast("double").alias(f"d_{p}") for p in DT_PARTS]),
    "t19_derive_numeric": lambda s, sf: _r(apply_steps(_li(s, sf), [
        {"type": "derive_numeric", "column_a": "l_extendedprice", "column_b": "l_discount", "op": "divide",
         "output_column": "price_per_discount"},
        {"type": "derive_numeric", "column_a": "l_quantity", "column_b": "l_tax", "op": "multiply"},
        {"type": "derive_numeric", "column_a": "l_quantity", "column_b": "l_tax", "op": "subtract",
         "output_column": "q_minus_t"}]), LINEITEM_KEY, ["price_per_discount", "derived_feature", "q_minus_t"]),
    "t20_target_encode": lambda s, sf: _r(apply_steps(table(s, sf, "customer"), [
        {"type": "target_encode_dataset", "columns": ["c_mktsegment", "c_nationkey"], "target_column": "c_acctbal"}]),
        ["c_custkey"], ["c_mktsegment_tgtenc", "c_nationkey_tgtenc"]),
    "t20_target_encode_nulls": lambda s, sf: _r(apply_steps(orders_nulls(s, sf), [
        {"type": "target_encode_dataset", "columns": ["o_orderpriority"], "target_column": "o_totalprice"}]),
        ["o_orderkey"], ["o_orderpriority_tgtenc"]),
    "t22_apply_pipeline": lambda s, sf: apply_steps(orders_nulls(s, sf), PIPE_STEPS).select(
        "o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderstatus_O", "o_orderstatus_P",
        "o_orderpriority", F.round("o_orderpriority_freq", 6).alias("o_orderpriority_freq")),
}


def _clip_sql(tbl, key, col, lo, hi, cte=""):
    return f"""{cte}SELECT {key}, {R(f'CASE WHEN {col} IS NULL THEN NULL ELSE greatest(least({col}, b.hi), b.lo) END')} AS {col}
FROM {tbl}, (SELECT {lo} AS lo, {hi} AS hi FROM {tbl}) b"""


def _scale_sql(kind):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    aggs, exprs = [], []
    for c in cols:
        if kind == "standard":
            aggs.append(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS b_{c}")
        elif kind == "minmax":
            aggs.append(f"min({c}) AS a_{c}, CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END AS b_{c}")
        else:
            aggs.append(f"quantile_cont({c}, 0.5) AS a_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 "
                        f"THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS b_{c}")
        exprs.append(f"{R(f'({c} - p.a_{c}) / p.b_{c}')} AS {c}")
    return f"""SELECT {', '.join(LINEITEM_KEY)}, {', '.join(exprs)}
FROM lineitem, (SELECT {', '.join(aggs)} FROM lineitem) p"""


def _skew_gate(col, tbl="events"):
    from tabsmith.plans.sqlgen import skew_sql

    return f"(SELECT abs({skew_sql(f'CAST({col} AS DOUBLE)')}) >= 0.5 AND count({col}) >= 3 FROM {tbl})"


def _bins_sql():
    def ew(col, n):
        p = f"(SELECT min({col}) AS mn, max({col}) AS mx, (max({col}) - min({col})) / {n} AS st FROM lineitem)"
        edges = [f"(p_{col}.mn - (p_{col}.mx - p_{col}.mn) * 0.001)"] + \
                [f"(CAST({i} AS DOUBLE) * p_{col}.st + p_{col}.mn)" for i in range(1, n)] + [f"p_{col}.mx"]
        cnt = " + ".join(f"(CASE WHEN {e} < {col} THEN 1 ELSE 0 END)" for e in edges)
        return p, f"CAST(greatest({cnt} - 1, 0) AS BIGINT) AS {col}_bin"
    p1, e1 = ew("l_discount", 10)
    p2, e2 = ew("l_quantity", 5)
    return f"""SELECT {', '.join(LINEITEM_KEY)}, {e1}, {e2} FROM lineitem, {p1} p_l_discount, {p2} p_l_quantity"""


def _pipe_sql():
    return ON_CTE.rstrip() + """,
s1 AS (SELECT * REPLACE (coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_nulls)) AS o_totalprice)
       FROM orders_nulls),
b2 AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM s1),
s2 AS (SELECT * REPLACE (CASE WHEN o_totalprice IS NULL THEN NULL ELSE greatest(least(o_totalprice, q3 + 1.5 * (q3 - q1)),
       q1 - 1.5 * (q3 - q1)) END AS o_totalprice) FROM s1, b2),
p3 AS (SELECT avg(o_totalprice) AS m, CASE WHEN stddev_pop(o_totalprice) = 0 THEN 1.0 ELSE stddev_pop(o_totalprice) END AS sd FROM s2),
s3 AS (SELECT * REPLACE ((o_totalprice - m) / sd AS o_totalprice) FROM s2, p3),
f AS (SELECT o_orderpriority AS k, CAST(count(*) AS DOUBLE) / (SELECT count(o_orderpriority) FROM s3) AS fr
      FROM s3 WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, """ + R("o_totalprice") + """ AS o_totalprice,
       CAST(coalesce(o_orderstatus = 'O', FALSE) AS INTEGER) AS o_orderstatus_O,
       CAST(coalesce(o_orderstatus = 'P', FALSE) AS INTEGER) AS o_orderstatus_P,
       o_orderpriority, """ + R("f.fr", 6) + """ AS o_orderpriority_freq
FROM s3 LEFT JOIN f ON s3.o_orderpriority = f.k"""


_PRICE_MODE = """(SELECT v FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders_nulls WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 1))"""

ORACLE = {
    "t01_drop_columns": "SELECT * EXCLUDE (l_tax, l_discount, l_shipdate) FROM lineitem",
    "t02_rename_columns": "SELECT * RENAME (l_quantity AS qty, l_tax AS tax_rate) FROM lineitem",
    "t03a_impute_mean": ON_CTE + f"""SELECT o_orderkey, {R('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_nulls))')}
  AS o_totalprice FROM orders_nulls""",
    "t03b_impute_median": ON_CTE + f"""SELECT o_orderkey,
  {R('coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_nulls))')} AS o_totalprice FROM orders_nulls""",
    "t03c_impute_mode": ON_CTE + f"SELECT o_orderkey, coalesce(o_orderpriority, {_PRICE_MODE}) AS o_orderpriority FROM orders_nulls",
    "t03d_impute_zero": ON_CTE + "SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice FROM orders_nulls",
    "t04_one_hot_encode": """SELECT c_custkey, c_nationkey,
  CAST(coalesce(c_mktsegment = 'BUILDING', FALSE) AS INTEGER) AS c_mktsegment_BUILDING,
  CAST(coalesce(c_mktsegment = 'FURNITURE', FALSE) AS INTEGER) AS c_mktsegment_FURNITURE,
  CAST(coalesce(c_mktsegment = 'HOUSEHOLD', FALSE) AS INTEGER) AS c_mktsegment_HOUSEHOLD,
  CAST(coalesce(c_mktsegment = 'MACHINERY', FALSE) AS INTEGER) AS c_mktsegment_MACHINERY
FROM customer""",
    "t05_label_encode": """SELECT p_partkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(CAST(p_brand AS VARCHAR), 'nan')) - 1 AS BIGINT) AS p_brand,
  CAST(dense_rank() OVER (ORDER BY coalesce(CAST(p_type AS VARCHAR), 'nan')) - 1 AS BIGINT) AS p_type
FROM part""",
    "t05_label_encode_nulls": ON_CTE + """SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(CAST(o_orderpriority AS VARCHAR), 'nan')) - 1 AS BIGINT) AS o_orderpriority
FROM orders_nulls""",
    "t06a_clip_iqr": _clip_sql("events", "event_id", "value",
                               "quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))",
                               "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))"),
    "t06b_clip_zscore": _clip_sql("events", "event_id", "value", "avg(value) - 3 * stddev_samp(value)",
                                  "avg(value) + 3 * stddev_samp(value)"),
    "t06c_clip_percentile": _clip_sql("orders_nulls", "o_orderkey", "o_totalprice", "quantile_cont(o_totalprice, 0.05)",
                                      "quantile_cont(o_totalprice, 0.95)", ON_CTE),
    "t07a_scale_standard": _scale_sql("standard"),
    "t07b_scale_minmax": _scale_sql("minmax"),
    "t07c_scale_robust": _scale_sql("robust"),
    "t08_math_transform": f"""SELECT {', '.join(LINEITEM_KEY)},
  {R('ln(1 + greatest(l_extendedprice, 0.0))')} AS l_extendedprice,
  {R('CASE WHEN l_discount = 0 THEN NULL ELSE 1.0 / l_discount END')} AS l_discount,
  {R('sqrt(greatest(l_tax, 0.0))')} AS l_tax, {R('l_quantity * l_quantity')} AS sq_l_quantity,
  {R('abs(l_quantity)')} AS abs_l_quantity
FROM lineitem""",
    "t09c_fix_skewness_log1p": "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS o_totalprice FROM orders",
    "t09c_fix_skewness_sqrt": "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS o_totalprice FROM orders",
    "t09_fix_skewness_auto": f"""SELECT event_id,
  {R(f"CASE WHEN {_skew_gate('value')} AND (SELECT min(value) FROM events) >= 0 THEN ln(1 + greatest(value, 0.0)) ELSE value END")} AS value,
  {R(f"CASE WHEN {_skew_gate('user_id')} THEN NULL ELSE CAST(user_id AS DOUBLE) END")} AS user_id
FROM events""",
    "t10a_bin_equal_width": _bins_sql(),
    "t10b_bin_quantile": """SELECT event_id,
  CAST(greatest(len(list_filter(e, lambda x: x < value)) - 1, 0) AS BIGINT) AS value_bin
FROM events, (SELECT list_distinct(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM events) p""",
    "t11a_drop_duplicates_first": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey, l_linenumber ORDER BY {md5_key(LINEITEM_KEY)}) AS rn FROM lineitem) WHERE rn = 1""",
    "t11a_drop_duplicates_last": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey, l_linenumber ORDER BY {md5_key(LINEITEM_KEY)} DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "t11b_drop_duplicates_none": """SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
  FROM lineitem) WHERE n = 1""",
    "t11c_drop_duplicates_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "t12_drop_nulls_any": ON_CTE + """SELECT * FROM orders_nulls WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL
  AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL""",
    "t12_drop_nulls_all": ON_CTE + "SELECT * FROM orders_nulls WHERE o_totalprice IS NOT NULL OR o_orderpriority IS NOT NULL",
    "t13_frequency_encode": f"""SELECT {', '.join(LINEITEM_KEY)},
  {R('CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) / count(*) OVER ()', 6)} AS l_returnflag_freq,
  {R('CAST(count(*) OVER (PARTITION BY l_shipdate) AS DOUBLE) / count(*) OVER ()', 6)} AS l_shipdate_freq
FROM lineitem""",
    "t13_frequency_encode_counts": ON_CTE + """SELECT o_orderkey,
  CAST(CASE WHEN o_orderpriority IS NULL THEN NULL ELSE count(o_orderpriority) OVER (PARTITION BY o_orderpriority) END
    AS DOUBLE) AS o_orderpriority_freq,
  CAST(CASE WHEN o_totalprice IS NULL THEN NULL ELSE count(o_totalprice) OVER (PARTITION BY o_totalprice) END
    AS DOUBLE) AS o_totalprice_freq
FROM orders_nulls""",
    "t14a_cast_float": "WITH " + MIXED_SQL + "\nSELECT o_orderkey, TRY_CAST(v AS DOUBLE) AS v FROM mixed",
    "t14b_cast_int": "WITH " + MIXED_SQL + "\nSELECT o_orderkey, CAST(CAST(round_even(TRY_CAST(v AS DOUBLE), 0) AS BIGINT) AS DOUBLE) AS v FROM mixed",
    "t14c_cast_str": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
    "t15_polynomial_features": f"""SELECT {', '.join(LINEITEM_KEY)}, {R('l_quantity')} AS poly_l_quantity,
  {R('l_discount')} AS poly_l_discount, {R('l_quantity * l_quantity')} AS poly_l_quantitypow2,
  {R('l_quantity * l_discount')} AS poly_l_quantity_l_discount, {R('l_discount * l_discount')} AS poly_l_discountpow2
FROM lineitem""",
    "t15_polynomial_interactions": f"""SELECT {', '.join(LINEITEM_KEY)}, 1.0 AS poly_1, {R('l_quantity')} AS poly_l_quantity,
  {R('l_discount')} AS poly_l_discount, {R('l_tax')} AS poly_l_tax, {R('l_quantity * l_discount')} AS poly_l_quantity_l_discount,
  {R('l_quantity * l_tax')} AS poly_l_quantity_l_tax, {R('l_discount * l_tax')} AS poly_l_discount_l_tax,
  {R('l_quantity * l_discount * l_tax')} AS poly_l_quantity_l_discount_l_tax
FROM lineitem""",
    "t16_extract_datetime": f"SELECT o_orderkey, {_dt_sql('o_orderdate', 'o_orderdate')} FROM orders",
    "t16_extract_datetime_strings": "WITH " + DATES_SQL + f"""
SELECT o_orderkey, {_dt_sql('TRY_CAST(d AS TIMESTAMP)', 'd', 'DOUBLE')} FROM ds""",
    "t19_derive_numeric": f"""SELECT {', '.join(LINEITEM_KEY)},
  {R('CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END')} AS price_per_discount,
  {R('l_quantity * l_tax')} AS derived_feature, {R('l_quantity - l_tax')} AS q_minus_t
FROM lineitem""",
    "t20_target_encode": f"""SELECT c_custkey,
  {R('coalesce(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), (SELECT avg(c_acctbal) FROM customer))')} AS c_mktsegment_tgtenc,
  {R('coalesce(avg(c_acctbal) OVER (PARTITION BY c_nationkey), (SELECT avg(c_acctbal) FROM customer))')} AS c_nationkey_tgtenc
FROM customer""",
    "t20_target_encode_nulls": ON_CTE + f"""SELECT o_orderkey,
  {R('coalesce(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), (SELECT avg(o_totalprice) FROM orders_nulls))')}
    AS o_orderpriority_tgtenc
FROM orders_nulls""",
    "t22_apply_pipeline": _pipe_sql(),
}
