"""Side-by-side check of a Spark DataFrame against DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    return repr(v)


def frame_digest(pdf: pd.DataFrame) -> tuple[list[str], int, str]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append("|".join(str(_norm(v.item() if hasattr(v, "item") and not isinstance(v, (list, dict)) else v))
                             for v in rec))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h


def compare(spark_df, sql: str, con) -> dict:
    sp = spark_df.toPandas()
    dk = con.sql(sql).df()
    scols, sn, sh = frame_digest(sp)
    dcols, dn, dh = frame_digest(dk)
    out = {"cols_match": scols == dcols, "rows_spark": sn, "rows_duck": dn, "hash_match": sh == dh}
    out["ok"] = out["cols_match"] and sn == dn and out["hash_match"]
    if not out["ok"]:
        out["spark_cols"], out["duck_cols"] = scols, dcols
        if scols == dcols:
            a = sp[scols].sort_values(scols).head(5).to_string()
            b = dk[dcols].sort_values(dcols).head(5).to_string()
            out["spark_head"], out["duck_head"] = a, b
    return out
