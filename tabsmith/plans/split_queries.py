"""Registered hold-out / fold queries (C01–C11, F03, F06) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators import split as S
from tabsmith.plans.fixtures import LINEITEM_KEY, ORDERS_NULLS_SQL, orders_nulls, table
from tabsmith.plans.sqlgen import md5_key

ON_CTE = "WITH " + ORDERS_NULLS_SQL + "\n"


def _o(s, sf):
    return table(s, sf, "orders")


def _li(s, sf):
    return table(s, sf, "lineitem")


QUERIES = {
    "c01_holdout_random": lambda s, sf: S.holdout_split(_o(s, sf), "o_totalprice", 0.2, 42, key=["o_orderkey"])
    .select("o_orderkey", SPLIT_COL),
    "c01_holdout_null_target": lambda s, sf: S.holdout_split(orders_nulls(s, sf), "o_totalprice", 0.25, 7,
                                                             key=["o_orderkey"]).select("o_orderkey", SPLIT_COL),
    "c02_holdout_stratified": lambda s, sf: S.holdout_split(_li(s, sf), "l_returnflag", 0.2, 42, key=LINEITEM_KEY)
    .select(*LINEITEM_KEY, SPLIT_COL),
    "c04_holdout_unshuffled": lambda s, sf: S.holdout_split(_o(s, sf), "o_orderpriority", 0.3, 42, shuffle=False,
                                                            stratify=False, order_by="o_orderkey")
    .select("o_orderkey", SPLIT_COL),
    "c03_c07_target_profile": lambda s, sf: S.target_profile_df(_li(s, sf), ["l_returnflag", "l_quantity",
                                                                              "l_extendedprice", "l_linenumber"]),
    "c08_kfold": lambda s, sf: S.kfold(_li(s, sf), 5, 42, LINEITEM_KEY).select(*LINEITEM_KEY, "fold"),
    "c09_stratified_kfold": lambda s, sf: S.stratified_kfold(_li(s, sf), "l_returnflag", 5, 42, LINEITEM_KEY)
    .select(*LINEITEM_KEY, "fold"),
    "c10_repeated_kfold": lambda s, sf: S.repeated_kfold(_o(s, sf), 4, 3, 42, ["o_orderkey"])
    .select("o_orderkey", "repeat", "fold"),
    "c11_shuffle_split": lambda s, sf: S.shuffle_split(_o(s, sf), 3, 0.1, 42, ["o_orderkey"])
    .select("o_orderkey", "split_id", "role"),
    "f03_complete_rows": lambda s, sf: S.complete_rows(orders_nulls(s, sf), "o_totalprice")
    .agg(F.count(F.lit(1)).alias("n_rows")),
}


def _alloc_sql(tbl: str, cls: str, test_size: float) -> str:
    """Largest-remainder train allocation per class; test = class count - train."""
    return f"""cc AS (SELECT CAST({cls} AS VARCHAR) AS cls, count(*) AS c FROM {tbl} WHERE {cls} IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(c) AS n, sum(c) - CAST(ceil(sum(c) * {test_size}) AS BIGINT) AS n_train FROM cc),
al AS (SELECT cls, c, c * n_train / n AS cont, floor(c * n_train / n) AS fl, n_train FROM cc, tot),
al2 AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, cls ASC) AS rr,
               n_train - sum(fl) OVER () AS need FROM al),
alloc AS (SELECT cls, c - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS nt FROM al2)"""


ORACLE = {
    "c01_holdout_random": f"""SELECT o_orderkey,
  CASE WHEN row_number() OVER (ORDER BY {md5_key(['o_orderkey'], 42)}) <= (SELECT ceil(count(*) * 0.2) FROM orders)
       THEN 'test' ELSE 'train' END AS {SPLIT_COL}
FROM orders""",
    "c01_holdout_null_target": ON_CTE + f"""SELECT o_orderkey,
  CASE WHEN o_totalprice IS NULL THEN NULL
       WHEN row_number() OVER (PARTITION BY o_totalprice IS NULL ORDER BY {md5_key(['o_orderkey'], 7)})
            <= (SELECT ceil(count(o_totalprice) * 0.25) FROM orders_nulls) THEN 'test' ELSE 'train' END AS {SPLIT_COL}
FROM orders_nulls""",
    "c02_holdout_stratified": "WITH " + _alloc_sql("lineitem", "l_returnflag", 0.2) + f""",
r AS (SELECT *, CAST(l_returnflag AS VARCHAR) AS cls,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5_key(LINEITEM_KEY, 42)}) AS rn FROM lineitem)
SELECT {', '.join(LINEITEM_KEY)}, CASE WHEN rn <= nt THEN 'test' ELSE 'train' END AS {SPLIT_COL}
FROM r JOIN alloc ON r.cls = alloc.cls""",
    "c04_holdout_unshuffled": f"""SELECT o_orderkey,
  CASE WHEN row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () - ceil(count(*) OVER () * 0.3)
       THEN 'test' ELSE 'train' END AS {SPLIT_COL}
FROM orders""",
    "c03_c07_target_profile": "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS target, CAST(count({c}) AS BIGINT) AS n, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
  {frac} AS fractional,
  CASE WHEN {'FALSE' if num else 'TRUE'} THEN 'classification' WHEN {frac} THEN 'regression'
       WHEN count(DISTINCT {c}) < 20 THEN 'classification' ELSE 'regression' END AS task,
  (count({c}) >= 2 AND count(DISTINCT {c}) >= 2 AND count(DISTINCT {c}) < 20 AND NOT {frac}) AS stratify_ok
FROM lineitem"""
        for c, num, frac in [("l_returnflag", False, "FALSE"),
                             ("l_quantity", True, "coalesce(max(CAST(l_quantity AS DOUBLE) % 1 <> 0), FALSE)"),
                             ("l_extendedprice", True, "coalesce(max(CAST(l_extendedprice AS DOUBLE) % 1 <> 0), FALSE)"),
                             ("l_linenumber", True, "FALSE")]),
    "c08_kfold": f"""SELECT {', '.join(LINEITEM_KEY)},
  CAST((row_number() OVER (ORDER BY {md5_key(LINEITEM_KEY, 42)}) - 1) % 5 AS INTEGER) AS fold FROM lineitem""",
    "c09_stratified_kfold": f"""WITH cc AS (SELECT CAST(l_returnflag AS VARCHAR) AS cls, count(*) AS c FROM lineitem GROUP BY 1),
off AS (SELECT cls, sum(c) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM cc),
r AS (SELECT *, CAST(l_returnflag AS VARCHAR) AS cls,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5_key(LINEITEM_KEY, 42)}) AS rn FROM lineitem)
SELECT {', '.join(LINEITEM_KEY)}, CAST((coalesce(off.o, 0) + rn - 1) % 5 AS INTEGER) AS fold
FROM r JOIN off ON r.cls = off.cls""",
    "c10_repeated_kfold": "\nUNION ALL\n".join(
        f"""SELECT o_orderkey, {r} AS repeat,
  CAST((row_number() OVER (ORDER BY {md5_key(['o_orderkey'], 42 + r)}) - 1) % 4 AS INTEGER) AS fold FROM orders"""
        for r in range(3)),
    "c11_shuffle_split": "\nUNION ALL\n".join(
        f"""SELECT o_orderkey, {s} AS split_id,
  CASE WHEN row_number() OVER (ORDER BY {md5_key(['o_orderkey'], 42 + s)}) <= (SELECT ceil(count(*) * 0.1) FROM orders)
       THEN 'val' ELSE 'train' END AS role FROM orders"""
        for s in range(3)),
    "f03_complete_rows": ON_CTE + """SELECT CAST(count(*) AS BIGINT) AS n_rows FROM orders_nulls
WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL
  AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL""",
}
