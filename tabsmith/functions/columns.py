"""Column selection, null normalisation, deterministic row order and long-format helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
ATOMIC_CATEGORICAL = (T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """Numeric columns in schema order (F01). Booleans are categorical unless asked for."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES) or (include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


def categorical_columns(df: DataFrame, include_bool: bool = True) -> list[str]:
    """Atomic non-numeric columns (strings, booleans, dates); arrays / maps / structs are skipped."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType) and not include_bool:
            continue
        if isinstance(f.dataType, ATOMIC_CATEGORICAL):
            out.append(f.name)
    return out


def q(name: str) -> Column:
    """Column reference that tolerates spaces and dots in names."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float / double columns (pandas treats NaN as missing)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(q(f.name)), F.lit(None)).otherwise(q(f.name)).alias(f.name))
        else:
            exprs.append(q(f.name))
    return df.select(*exprs)


def row_hash(cols: Sequence[str | Column], seed: int = 42) -> Column:
    """md5 over ``concat_ws('~', key columns..., seed)``: a deterministic, partition-independent
    row order. The same expression in DuckDB gives the same digest for integer / string /
    decimal keys."""
    parts = [(q(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("~", *parts, F.lit(str(seed))))


def default_key(df: DataFrame) -> list[Column]:
    """All atomic columns as the row key when a caller gives none; the helper column ``__o`` is left
    out."""
    return [q(f.name) for f in df.schema.fields
            if f.name != "__o" and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def long_numeric(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (), var: str = "column",
                 val: str = "value") -> DataFrame:
    """Unpivot numeric columns to (id..., column, value double)."""
    sel = [q(c) for c in id_cols] + [q(c).cast("double").alias(c) for c in cols]
    return df.select(*sel).unpivot(list(id_cols), list(cols), var, val)


def long_strings(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (), var: str = "column",
                 val: str = "value") -> DataFrame:
    sel = [q(c) for c in id_cols] + [q(c).cast("string").alias(c) for c in cols]
    return df.select(*sel).unpivot(list(id_cols), list(cols), var, val)


def quantile_expr(col: Column, probs: Sequence[float], exact: bool = True, accuracy: int = 100_000) -> Column:
    """Array of linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``) or the bounded
    sketch ``percentile_approx`` when ``exact`` is False (memory independent of distinct values)."""
    if exact:
        return F.percentile(col, F.array(*[F.lit(float(p)) for p in probs]))
    return F.percentile_approx(col, [float(p) for p in probs], accuracy).cast("array<double>")


