"""Small helpers that write the DuckDB oracle SQL for the registered queries."""

from __future__ import annotations

from collections.abc import Sequence


def R(expr: str, d: int = 4) -> str:
    """Rounded value; ``+ 0.0`` turns a rounded -0.0 into 0.0 as Spark's ``round`` does."""
    return f"(round({expr}, {d}) + 0.0)"


def RD(expr: str, d: int = 4) -> str:
    """Rounded like Spark's ``round`` on a double: HALF_UP on its shortest decimal form (DuckDB's
    ``round`` works on the binary value, which differs on exact half-way values)."""
    return f"(CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {d}) AS DOUBLE) + 0.0)"


def D(col: str) -> str:
    return f'CAST("{col}" AS DOUBLE)'


def md5_key(cols: Sequence[str], seed: int = 42, alias: str | None = None) -> str:
    pre = f"{alias}." if alias else ""
    parts = ", ".join(f'CAST({pre}"{c}" AS VARCHAR)' for c in cols)
    return f"md5(concat_ws('~', {parts}, '{seed}'))"


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long_sql(table: str, cols: Sequence[str], ids: Sequence[str] = (), cast: str = "DOUBLE") -> str:
    """Unpivot ``cols`` of ``table`` into ("column", value)."""
    idp = "".join(f'"{i}", ' for i in ids)
    return union_all([f"""SELECT {idp}'{c}' AS "column", CAST("{c}" AS {cast}) AS value FROM {table}""" for c in cols])


def hist_sql(long: str, bins: int, pad: float = 0.5) -> str:
    """NumPy-compatible equal-width histogram of a long ("column", value) relation: the bin of a
    value is the number of interior linspace edges <= value."""
    n = bins
    return f"""
WITH lv AS ({long}),
v AS (SELECT * FROM lv WHERE value IS NOT NULL),
rng0 AS (SELECT "column", min(value) AS mn, max(value) AS mx FROM v GROUP BY "column"),
p0 AS (SELECT "column",
             CASE WHEN mn = mx THEN mn - {pad} ELSE mn END AS f,
             CASE WHEN mn = mx THEN mx + {pad} ELSE mx END AS l
      FROM rng0),
p AS (SELECT "column", f, l, (l - f) / {n} AS st FROM p0),
pe AS (SELECT "column", list_transform(range(1, {max(n, 2)}), lambda k: CAST(k AS DOUBLE) * st + f) AS inner_edges FROM p),
b2 AS (SELECT v."column", CAST(len(list_filter(inner_edges, lambda e: e <= value)) AS INTEGER) AS bin
       FROM v JOIN pe ON v."column" = pe."column"),
cnt AS (SELECT "column", bin, count(*) AS c FROM b2 GROUP BY "column", bin),
spine AS (SELECT "column", f, l, st, CAST(unnest(range(0, {n})) AS INTEGER) AS bin FROM p)
SELECT s."column" AS "column", s.bin AS bin,
       {R(f"CASE WHEN s.bin >= {n} THEN s.l ELSE CAST(s.bin AS DOUBLE) * s.st + s.f END")} AS lo,
       {R(f"CASE WHEN s.bin + 1 >= {n} THEN s.l ELSE CAST(s.bin + 1 AS DOUBLE) * s.st + s.f END")} AS hi,
       CAST(coalesce(cnt.c, 0) AS BIGINT) AS count
FROM spine s LEFT JOIN cnt ON s."column" = cnt."column" AND s.bin = cnt.bin"""


def skew_sql(x: str) -> str:
    """Bias-corrected skewness as pandas: 0 for a constant, null below 3 values."""
    return f"CASE WHEN count({x}) < 3 THEN NULL WHEN var_pop({x}) = 0 THEN 0.0 ELSE skewness({x}) END"


def kurt_sql(x: str) -> str:
    return f"CASE WHEN count({x}) < 4 THEN NULL WHEN var_pop({x}) = 0 THEN 0.0 ELSE kurtosis({x}) END"


def corr_sql(x: str, y: str) -> str:
    xx = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
    yy = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END"
    return f"covar_pop({xx}, {yy}) / nullif(stddev_pop({xx}) * stddev_pop({yy}), 0)"
