"""Registered profiling queries (E01–E14) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import profile as P
from tabsmith.plans.fixtures import (
    LINEITEM_KEY,
    LINEITEM_NULLS_SQL,
    LINEITEM_NUM,
    ORDERS_NULLS_SQL,
    lineitem_nulls,
    orders_nulls,
    table,
)
from tabsmith.plans.sqlgen import D, R, corr_sql, hist_sql, kurt_sql, long_sql, md5_key, skew_sql, union_all

ON_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ON_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LI_CAT = ["l_returnflag", "l_linestatus", "l_shipdate"]
PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, sf):
    return table(spark, sf, "lineitem")


QUERIES = {
    "e01_column_stats": lambda s, sf: P.column_stats(_li(s, sf)),
    "e01_column_stats_nulls": lambda s, sf: P.column_stats(orders_nulls(s, sf)),
    "e02_histogram": lambda s, sf: P.histogram(_li(s, sf), 20),
    "e03_correlation": lambda s, sf: P.correlation_matrix(_li(s, sf)),
    "e03_correlation_nulls": lambda s, sf: P.correlation_matrix(orders_nulls(s, sf)),
    "e04_missing_values": lambda s, sf: P.missing_values(orders_nulls(s, sf)),
    "e05_outliers": lambda s, sf: P.outliers(_li(s, sf)),
    "e06_scatter_sample": lambda s, sf: P.scatter(_li(s, sf), "l_quantity", "l_extendedprice", "l_returnflag",
                                                 500, 42, LINEITEM_KEY),
    "e07_categorical_stats": lambda s, sf: P.categorical_stats(table(s, sf, "customer")),
    "e07_categorical_stats_nulls": lambda s, sf: P.categorical_stats(orders_nulls(s, sf)),
    "e08a_health_summary": lambda s, sf: P.health_summary(_li(s, sf)),
    # nine significant digits: variances of keys and of shares don't fit one number of decimals
    "e08_health_columns": lambda s, sf: P.health_columns(lineitem_nulls(s, sf), None).withColumn(
        "variance", F.when(F.col("variance").isNotNull(), F.format_string("%.8e", "variance"))),
    "e08e_dtype_summary": lambda s, sf: P.dtype_summary(lineitem_nulls(s, sf)),
    "e09a_target_histogram": lambda s, sf: P.target_histogram(_li(s, sf), "l_extendedprice"),
    "e13a_feature_target_points": lambda s, sf: P.feature_target_points(_li(s, sf), "l_extendedprice", key=LINEITEM_KEY),
    "e09a_target_numeric": lambda s, sf: P.target_numeric(_li(s, sf), "l_extendedprice"),
    "e09b_target_classes": lambda s, sf: P.target_classes(_li(s, sf), "l_returnflag"),
    "e10_skew_report": lambda s, sf: P.skew_report(_li(s, sf)),
    "e11_box_stats": lambda s, sf: P.box_stats(_li(s, sf)),
    "e11_box_outliers": lambda s, sf: P.box_outliers(table(s, sf, "events"), ["value", "user_id"], key=["event_id"]),
    "e05_outliers_events": lambda s, sf: P.outliers(table(s, sf, "events")),
    "e12_pairplot_points": lambda s, sf: P.pairplot_points(_li(s, sf), PAIR_COLS, key=LINEITEM_KEY),
    "e12_pairplot_hist": lambda s, sf: P.pairplot_hist(_li(s, sf), PAIR_COLS, key=LINEITEM_KEY),
    "e13a_feature_target_numeric": lambda s, sf: P.feature_target_numeric(_li(s, sf), "l_extendedprice"),
    "e13b_feature_target_classes": lambda s, sf: P.feature_target_classes(_li(s, sf), "l_returnflag"),
    "e14_top_correlated": lambda s, sf: P.top_correlated(_li(s, sf), "l_extendedprice", 5),
}


def _stats_sql(tbl: str, cols, with_cte: str = "") -> str:
    parts = []
    for c in cols:
        x = D(c)
        parts.append(f"""SELECT '{c}' AS "column", {R(f'avg({x})')} AS mean, {R(f'stddev_samp({x})')} AS std,
  {R(f'min({x})')} AS min, {R(f'max({x})')} AS max, {R(f'quantile_cont({x}, 0.5)')} AS median,
  {R(f'quantile_cont({x}, 0.25)')} AS q25, {R(f'quantile_cont({x}, 0.75)')} AS q75
FROM {tbl} HAVING count({x}) > 0""")
    return with_cte + union_all(parts)


def _corr_sql(tbl: str, cols, cte: str = "") -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            r = R(corr_sql(D(a), D(b)))
            parts.append(f"SELECT '{a}' AS col_x, '{b}' AS col_y, {r} AS r FROM {tbl}")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_x, '{a}' AS col_y, {r} AS r FROM {tbl}")
    return cte + union_all(parts)


def _catstats_sql(tbl: str, cols, cte: str = "") -> str:
    lv = union_all([f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value FROM {tbl}""" for c in cols])
    head = cte.rstrip() + "," if cte else "WITH"
    return f"""{head} lv AS ({lv}),
vc AS (SELECT "column", value, count(*) AS count FROM lv WHERE value IS NOT NULL GROUP BY "column", value),
nu AS (SELECT "column", count(*) AS n_unique FROM vc GROUP BY "column"),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC) AS rank FROM vc)
SELECT rk."column", CAST(nu.n_unique AS BIGINT) AS n_unique, rk.value, CAST(rk.count AS BIGINT) AS count,
       CAST(rk.rank AS INTEGER) AS rank
FROM rk JOIN nu ON rk."column" = nu."column" WHERE rk.rank <= 10"""


LN_NUM = LINEITEM_NUM
LN_ALL = [*LINEITEM_NUM, *LI_CAT]


def _health_cols_sql() -> str:
    num, cat = LN_NUM, [c for c in LN_ALL if c not in LN_NUM]
    parts = []
    for c in num + cat:
        isnum = c in num
        nd = f"count(DISTINCT {D(c)})" if isnum else f'count(DISTINCT CAST("{c}" AS VARCHAR))'
        var = f"printf('%.8e', CASE WHEN count(\"{c}\") > 1 THEN var_samp({D(c)}) ELSE 0.0 END)" if isnum else "CAST(NULL AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS "column", '{'numeric' if isnum else 'categorical'}' AS kind,
  CAST({nd} AS BIGINT) AS n_distinct,
  {'TRUE' if isnum else 'FALSE'} AND {nd} <= 1 AS is_constant,
  {'TRUE' if isnum else 'FALSE'} AND {nd} > 1 AND {nd} <= greatest(2, CAST(floor(count(*) * 0.01) AS BIGINT)) AS is_near_constant,
  {'FALSE' if isnum else 'TRUE'} AND count(*) > 0 AND CAST({nd} AS DOUBLE) / count(*) > 0.5 AS is_high_card,
  {R(f'(1 - CAST(count(*) - count("{c}") AS DOUBLE) / count(*)) * 100', 1)} AS completeness,
  {var} AS variance
FROM lineitem_nulls""")
    return "WITH " + LINEITEM_NULLS_SQL + "\n" + union_all(parts)


def _skew_sql(tbl: str, cols) -> str:
    parts = []
    for c in cols:
        x = D(c)
        sk = skew_sql(x)
        parts.append(f"""SELECT '{c}' AS "column", {R(sk)} AS skewness, {R(kurt_sql(x))} AS kurtosis,
  {R(f'abs({sk})')} AS abs_skewness,
  CASE WHEN abs({sk}) < 0.5 THEN 'normal' WHEN abs({sk}) < 1.0 THEN 'moderate' ELSE 'high' END AS severity,
  CASE WHEN abs({sk}) < 0.5 THEN NULL WHEN abs({sk}) < 1.0 THEN (CASE WHEN {sk} > 0 THEN 'sqrt' ELSE 'square' END)
       ELSE (CASE WHEN {sk} > 0 THEN 'log1p' ELSE 'reciprocal' END) END AS hint
FROM {tbl} HAVING count({x}) >= 3""")
    return union_all(parts)


def _box_sql(tbl: str, cols) -> str:
    parts = []
    for c in cols:
        x = D(c)
        q1, q3 = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
        parts.append(f"""SELECT '{c}' AS "column", {R(f'min({x})')} AS min, {R(q1)} AS q1,
  {R(f'quantile_cont({x}, 0.5)')} AS median, {R(f'avg({x})')} AS mean, {R(q3)} AS q3, {R(f'max({x})')} AS max,
  {R(f'{q1} - 1.5 * ({q3} - {q1})')} AS lower_fence, {R(f'{q3} + 1.5 * ({q3} - {q1})')} AS upper_fence
FROM {tbl} HAVING count({x}) > 0""")
    return union_all(parts)


def _box_outliers_sql() -> str:
    cols = ["value", "user_id"]
    lv = long_sql("hk", cols, ids=["h"])
    b = union_all([f"""SELECT '{c}' AS "column", quantile_cont({D(c)}, 0.25) AS q1, quantile_cont({D(c)}, 0.75) AS q3
FROM events""" for c in cols])
    return f"""WITH hk AS (SELECT *, {md5_key(["event_id"])} AS h FROM events),
lv AS ({lv}),
b AS (SELECT "column", q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ({b})),
o AS (SELECT lv."column", lv.value, lv.h FROM lv JOIN b ON lv."column" = b."column" WHERE lv.value < b.lo OR lv.value > b.hi),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY h) AS rn FROM o)
SELECT "column", {R('value')} AS value FROM r WHERE rn <= 60"""


def _pair_sample_sql() -> str:
    nn = " AND ".join(f'"{c}" IS NOT NULL' for c in PAIR_COLS)
    return f"""samp AS (SELECT * FROM lineitem WHERE {nn} ORDER BY {md5_key(LINEITEM_KEY)} LIMIT 300)"""


def _pair_points_sql() -> str:
    parts = [f"""SELECT '{a}' AS col_x, '{b}' AS col_y, {R(D(a))} AS x, {R(D(b))} AS y FROM samp"""
             for a in PAIR_COLS for b in PAIR_COLS if a != b]
    return f"WITH {_pair_sample_sql()}\n" + union_all(parts)


def _pair_hist_sql() -> str:
    return f"WITH {_pair_sample_sql()}\n" + "SELECT * FROM (" + hist_sql(long_sql("samp", PAIR_COLS), 15) + ")"


def _ft_num_sql() -> str:
    parts = []
    y = D("l_extendedprice")
    for c in LINEITEM_NUM:
        if c == "l_extendedprice":
            continue
        x = D(c)
        parts.append(f"""SELECT '{c}' AS "column", {R(corr_sql(x, y))} AS correlation,
  CASE WHEN stddev_pop({x}) > 0 THEN {R(f'regr_slope({y}, {x})', 6)} END AS slope,
  CASE WHEN stddev_pop({x}) > 0 THEN {R(f'regr_intercept({y}, {x})')} END AS intercept,
  CASE WHEN stddev_pop({x}) > 0 THEN {R(f'min({x})')} END AS trend_x0,
  CASE WHEN stddev_pop({x}) > 0 THEN {R(f'max({x})')} END AS trend_x1,
  CASE WHEN stddev_pop({x}) > 0 THEN {R(f'regr_slope({y}, {x}) * min({x}) + regr_intercept({y}, {x})')} END AS trend_y0,
  CASE WHEN stddev_pop({x}) > 0 THEN {R(f'regr_slope({y}, {x}) * max({x}) + regr_intercept({y}, {x})')} END AS trend_y1
FROM lineitem WHERE {x} IS NOT NULL AND {y} IS NOT NULL HAVING count(*) > 0""")
    return union_all(parts)


def _ft_cls_sql() -> str:
    feats = [c for c in LINEITEM_NUM if c != "l_returnflag"]
    lv = long_sql("base", feats, ids=["class"])
    return f"""WITH cls AS (SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS c FROM lineitem WHERE l_returnflag IS NOT NULL
             ORDER BY c LIMIT 10),
base AS (SELECT CAST(l_returnflag AS VARCHAR) AS class, * FROM lineitem WHERE CAST(l_returnflag AS VARCHAR) IN (SELECT c FROM cls)),
lv AS ({lv})
SELECT "column", class, {R('quantile_cont(value, 0.25)')} AS q1, {R('quantile_cont(value, 0.5)')} AS median,
       {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.75)')} AS q3, {R('min(value)')} AS min, {R('max(value)')} AS max
FROM lv WHERE value IS NOT NULL GROUP BY "column", class"""


def _topcorr_sql() -> str:
    y = D("l_extendedprice")
    parts = [f"""SELECT '{c}' AS "column", {R(corr_sql(D(c), y))} AS r FROM lineitem""" for c in LINEITEM_NUM
             if c != "l_extendedprice"]
    return f"""WITH c AS ({union_all(parts)})
SELECT "column", r, CAST(row_number() OVER (ORDER BY abs(coalesce(r, 0.0)) DESC, "column" ASC) AS INTEGER) AS rank
FROM c ORDER BY abs(coalesce(r, 0.0)) DESC, "column" ASC LIMIT 5"""


def _dtype_sql() -> str:
    each = union_all([f"""SELECT '{c}' AS name, count("{c}") AS n FROM lineitem_nulls""" for c in LN_ALL])
    return f"""WITH {LINEITEM_NULLS_SQL}, v AS ({each}),
t AS (SELECT column_name AS name, row_number() OVER () AS place,
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype
  FROM (DESCRIBE lineitem))
SELECT dtype, CASE WHEN dtype IN ('bigint', 'int', 'double') THEN 'numeric' ELSE 'categorical' END AS kind, CAST(count(*) AS BIGINT) AS n_columns,
  string_agg(name, ',' ORDER BY place) AS columns, CAST(sum(n) AS BIGINT) AS n_values FROM t JOIN v USING (name) GROUP BY dtype"""


def _ft_points_sql() -> str:
    return union_all([f"""(SELECT '{c}' AS "column", {R(D(c))} AS x, {R(D('l_extendedprice'))} AS y FROM lineitem
  ORDER BY {md5_key(LINEITEM_KEY, 42)} LIMIT 400)""" for c in LINEITEM_NUM if c != "l_extendedprice"])


def _target_num_sql() -> str:
    y = D("l_extendedprice")
    sk = skew_sql(y)
    return f"""SELECT 'l_extendedprice' AS target_col, CAST(count({y}) AS BIGINT) AS n, {R(sk)} AS skewness,
  {R(kurt_sql(y))} AS kurtosis, {R(f'avg({y})')} AS mean, {R(f'stddev_samp({y})')} AS std, {R(f'min({y})')} AS min,
  {R(f'max({y})')} AS max, {R(f'quantile_cont({y}, 0.5)')} AS median,
  CASE WHEN abs({sk}) < 0.5 THEN NULL WHEN {sk} > 2 THEN 'log1p (strong right skew)'
       WHEN {sk} > 0.5 THEN 'sqrt (moderate right skew)' WHEN {sk} < -2 THEN 'square / reciprocal (strong left skew)'
       ELSE 'sqrt or reflect + log1p (moderate left skew)' END AS transform_hint
FROM lineitem"""


def _target_cls_sql() -> str:
    return """WITH vc AS (SELECT CAST(l_returnflag AS VARCHAR) AS class, count(*) AS count FROM lineitem
            WHERE l_returnflag IS NOT NULL GROUP BY 1),
t AS (SELECT sum(count) AS total, count(*) AS n_classes, max(count) AS mx, min(count) AS mn FROM vc)
SELECT class, CAST(count AS BIGINT) AS count, (round(CAST(count AS DOUBLE) / total * 100, 2) + 0.0) AS pct,
       CAST(n_classes AS BIGINT) AS n_classes,
       CASE WHEN n_classes > 1 THEN round(CAST(mx AS DOUBLE) / mn, 2) ELSE 1.0 END AS imbalance_ratio,
       (CASE WHEN n_classes > 1 THEN round(CAST(mx AS DOUBLE) / mn, 2) ELSE 1.0 END) > 3.0 AS is_imbalanced
FROM vc, t"""


def _outliers_sql(tbl: str = "lineitem", cols=tuple(LINEITEM_NUM)) -> str:
    parts = []
    for c in cols:
        x = D(c)
        parts.append(f"""SELECT '{c}' AS "column", q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {tbl})""")
    lv = long_sql(tbl, cols)
    return f"""WITH b AS ({union_all(parts)}), lv AS ({lv})
SELECT b."column", {R('b.lo')} AS lower, {R('b.hi')} AS upper,
       CAST(count(*) FILTER (WHERE lv.value < b.lo OR lv.value > b.hi) AS BIGINT) AS n_outliers
FROM b JOIN lv ON b."column" = lv."column" GROUP BY b."column", b.lo, b.hi"""


ORACLE = {
    "e01_column_stats": _stats_sql("lineitem", LINEITEM_NUM),
    "e01_column_stats_nulls": _stats_sql("orders_nulls", ON_NUM, "WITH " + ORDERS_NULLS_SQL + "\n"),
    "e02_histogram": hist_sql(long_sql("lineitem", LINEITEM_NUM), 20),
    "e03_correlation": _corr_sql("lineitem", LINEITEM_NUM),
    "e03_correlation_nulls": _corr_sql("orders_nulls", ON_NUM, "WITH " + ORDERS_NULLS_SQL + "\n"),
    "e04_missing_values": "WITH " + ORDERS_NULLS_SQL + "\n" + union_all([
        f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE "{c}" IS NULL) AS BIGINT) AS count,
  {R(f'CAST(count(*) FILTER (WHERE "{c}" IS NULL) AS DOUBLE) / count(*) * 100', 2)} AS pct FROM orders_nulls"""
        for c in ON_ALL]),
    "e05_outliers": _outliers_sql(),
    "e05_outliers_events": _outliers_sql("events", ("event_id", "user_id", "value")),
    "e06_scatter_sample": f"""SELECT {R(D('l_quantity'))} AS x, {R(D('l_extendedprice'))} AS y, l_returnflag AS color
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL
ORDER BY {md5_key(LINEITEM_KEY)} LIMIT 500""",
    "e07_categorical_stats": _catstats_sql("customer", ["c_name", "c_mktsegment"]),
    "e07_categorical_stats_nulls": _catstats_sql("orders_nulls", ["o_orderstatus", "o_orderdate", "o_orderpriority"],
                                                 "WITH " + ORDERS_NULLS_SQL),
    "e08a_health_summary": f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS BIGINT) AS n_cols,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS n_duplicates
FROM lineitem""",
    "e08_health_columns": _health_cols_sql(),
    "e08e_dtype_summary": _dtype_sql(),
    "e09a_target_histogram": hist_sql(long_sql("lineitem", ["l_extendedprice"]), 20),
    "e13a_feature_target_points": _ft_points_sql(),
    "e09a_target_numeric": _target_num_sql(),
    "e09b_target_classes": _target_cls_sql(),
    "e10_skew_report": _skew_sql("lineitem", LINEITEM_NUM),
    "e11_box_stats": _box_sql("lineitem", LINEITEM_NUM),
    "e11_box_outliers": _box_outliers_sql(),
    "e12_pairplot_points": _pair_points_sql(),
    "e12_pairplot_hist": _pair_hist_sql(),
    "e13a_feature_target_numeric": _ft_num_sql(),
    "e13b_feature_target_classes": _ft_cls_sql(),
    "e14_top_correlated": _topcorr_sql(),
}
