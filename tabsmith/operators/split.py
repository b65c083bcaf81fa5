"""Hold-out labels and fold assignment.

Row order is the md5 digest of the row key and a seed, so assignments are reproducible at
any partitioning and after any task retry. Hold-out labels come from digest thresholds, fold ranks from ``hash_rank`` (two phases,
no global window). Per-class allocations are tiny tables computed on the driver from class
counts (stratification needs fewer than 20 classes) and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith import SPLIT_COL
from tabsmith.functions.columns import NUMERIC_TYPES, default_key, q, row_hash
from tabsmith.functions.ranking import first_by_digest, hash_rank, ordered_rank


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType, T.DecimalType))


def target_profile(df: DataFrame, target: str) -> dict:
    """One aggregate: non-null count, whether any value is fractional, and up to 20 distinct
    values (enough to decide every rule below)."""
    y = q(target)
    frac = F.max((y.cast("double") % 1 != 0).cast("int")) if _is_float(df, target) else F.lit(0)
    r = df.agg(F.count(y).alias("n"), frac.alias("frac")).first()
    distinct = df.where(y.isNotNull()).select(y).distinct().limit(20).count()
    return {"n": r["n"], "fractional": bool(r["frac"]), "n_distinct_capped": distinct}


def stratify_ok(df: DataFrame, target: str) -> bool:
    """>= 2 values, >= 2 distinct, < 20 distinct, no fractional floats."""
    p = target_profile(df, target)
    return p["n"] >= 2 and 2 <= p["n_distinct_capped"] < 20 and not p["fractional"]


def detect_task(df: DataFrame, target: str) -> str:
    """C07 (nulls dropped first): fractional floats -> regression, non-numeric -> classification,
    fewer than 20 distinct -> classification, else regression."""
    if not isinstance(df.schema[target].dataType, NUMERIC_TYPES):
        return "classification"
    p = target_profile(df, target)
    if p["fractional"]:
        return "regression"
    return "classification" if p["n_distinct_capped"] < 20 else "regression"


def largest_remainder(counts: dict, n_draws: int) -> dict:
    """Allocate ``n_draws`` over classes proportionally: floors, then +1 to the largest
    remainders (ties by class order)."""
    total = sum(counts.values())
    cont = {k: v * n_draws / total for k, v in counts.items()}
    alloc = {k: math.floor(v) for k, v in cont.items()}
    need = n_draws - sum(alloc.values())
    order = sorted(counts, key=lambda k: (-(cont[k] - alloc[k]), k))
    for k in order[:need]:
        alloc[k] += 1
    return alloc


def holdout_split(df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42, shuffle: bool = True,
                  stratify: bool = True, key: Sequence[str] | None = None, order_by: str | None = None,
                  classes_below: int | None = 20) -> DataFrame:
    """Add ``__ml_split__`` = train / test for rows with a non-null target (others
    null). n_test = ceil(n * test_size) (test_size clamped to [.05, .95]); stratified
    allocation by largest remainder when the target has 2 classes or more and fewer than
    ``classes_below`` (None: any number, as for training on a class target); unshuffled = the last n_test
    rows in ``order_by`` order are test."""
    if not target or target not in df.columns:
        raise ValueError(f"a hold-out needs its target; there is no column {target!r}")
    test_size = min(0.95, max(0.05, float(test_size)))
    base = df.drop(SPLIT_COL) if SPLIT_COL in df.columns else df
    y = q(target)
    # pass 1: usable rows and the fractional-float check (C03) in one aggregate
    frac = F.max((y.cast("double") % 1 != 0).cast("int")) if _is_float(base, target) else F.lit(0)
    prof = base.agg(F.count(y).alias("n"), frac.alias("frac")).first()
    n = prof["n"]
    if n < 2:
        raise ValueError(f"a hold-out needs two rows with a target, {target!r} has {n}")
    n_test = math.ceil(n * test_size)
    n_train = n - n_test
    counts = None
    if stratify and not prof["frac"]:
        # pass 2: the class counts decide eligibility and give the allocation
        vc = base.where(y.isNotNull()).groupBy(y.cast("string").alias("c")).count()
        vc = (vc if classes_below is None else vc.limit(classes_below)).collect()
        if len(vc) >= 2 and (classes_below is None or len(vc) < classes_below):
            counts = {r["c"]: r["count"] for r in vc}
    strat = counts is not None
    if strat and not shuffle:
        raise ValueError("rows in order can't be stratified: set stratify=False or shuffle=True")
    cols = base.columns
    keyed = base.withColumn("__h", row_hash(key if key else default_key(base), seed))
    usable = keyed.where(y.isNotNull())
    rest = keyed.where(y.isNull()).withColumn(SPLIT_COL, F.lit(None).cast("string"))
    if not shuffle and order_by:
        ranked = ordered_rank(usable, order_by, "__rn")
        labeled = ranked.withColumn(SPLIT_COL, F.when(F.col("__rn") > n_train, "test").otherwise("train"))
    elif not shuffle:
        labeled = first_by_digest(usable, "__h", {None: n_train}, out="__first").withColumn(SPLIT_COL, F.when(F.col("__first"), "train").otherwise("test"))
    else:
        if strat:
            train_alloc = largest_remainder(counts, n_train)
            drawn = first_by_digest(usable.withColumn("__cls", y.cast("string")), "__h", {c: counts[c] - train_alloc[c] for c in counts}, "__cls", "__first")
        else:
            drawn = first_by_digest(usable, "__h", {None: n_test}, out="__first")
        labeled = drawn.withColumn(SPLIT_COL, F.when(F.col("__first"), "test").otherwise("train"))
    return labeled.select(*[q(c) for c in cols], SPLIT_COL).unionByName(rest.select(*[q(c) for c in cols], SPLIT_COL))


def split_rows(df: DataFrame, label: str = SPLIT_COL) -> tuple[DataFrame, DataFrame]:
    """(train rows, test rows); errors unless only train / test labels occur and both exist."""
    bad, n_tr, n_te = df.agg(
        F.count_if(F.col(label).isNotNull() & ~F.col(label).isin("train", "test")),
        F.count_if(F.col(label) == "train"), F.count_if(F.col(label) == "test")).first()
    if bad:
        raise ValueError(f"{label} may only contain 'train' and 'test'")
    if n_tr == 0 or n_te == 0:
        raise ValueError("both train and test rows are required")
    return df.where(F.col(label) == "train"), df.where(F.col(label) == "test")


def kfold(df: DataFrame, k: int = 5, seed: int = 42, key: Sequence[str] | None = None, out: str = "fold") -> DataFrame:
    """fold = (rank by digest - 1) mod k; fold sizes differ by at most one and the first
    n mod k folds are the larger ones."""
    keyed = df.withColumn("__h", row_hash(key if key else default_key(df), seed))
    ranked = hash_rank(keyed, "__h", out="__rn")
    return ranked.withColumn(out, ((F.col("__rn") - 1) % k).cast("int")).drop("__h", "__rn")


def stratified_kfold(df: DataFrame, target: str, k: int = 5, seed: int = 42, key: Sequence[str] | None = None,
                     out: str = "fold") -> DataFrame:
    """Rows dealt round-robin over folds in (class, digest) order: fold = (offset of the
    class + rank inside the class - 1) mod k, so per-class fold counts match stratified k-fold.
    Rows with a null target get no fold."""
    y = q(target)
    keyed = df.withColumn("__h", row_hash(key if key else default_key(df), seed))
    usable = keyed.where(y.isNotNull())
    counts = sorted(((r[0], r[1]) for r in usable.groupBy(y.alias("c")).count().collect()), key=lambda t: t[0])
    offs, acc = [], 0
    for c, n in counts:
        offs.append((str(c), acc))
        acc += n
    offsets = df.sparkSession.createDataFrame(offs, "__cls string, __off long")
    ranked = hash_rank(usable.withColumn("__cls", y.cast("string")), "__h", groups=["__cls"], out="__rn")
    res = (ranked.join(F.broadcast(offsets), on="__cls")
           .withColumn(out, ((F.col("__off") + F.col("__rn") - 1) % k).cast("int"))
           .drop("__h", "__rn", "__cls", "__off"))
    return res.unionByName(keyed.where(y.isNull()).drop("__h").withColumn(out, F.lit(None).cast("int")))


def repeated_kfold(df: DataFrame, k: int = 5, repeats: int = 3, seed: int = 42, key: Sequence[str] | None = None,
                   target: str | None = None) -> DataFrame:
    """``repeats`` independent (stratified when ``target`` is given) fold assignments, one
    per seed ``seed + r``; long output with a ``repeat`` column."""
    parts = []
    for r in range(repeats):
        f = (stratified_kfold(df, target, k, seed + r, key) if target else kfold(df, k, seed + r, key))
        parts.append(f.withColumn("repeat", F.lit(r)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffle_split(df: DataFrame, n_splits: int = 5, val_size: float = 0.1, seed: int = 42,
                  key: Sequence[str] | None = None) -> DataFrame:
    """C11: ``n_splits`` independent draws; in draw s the ceil(n * val_size) rows with the
    smallest digest under seed ``seed + s`` are ``val``. Long output (row, split_id, role)."""
    n = df.count()
    n_val = math.ceil(n * val_size)
    parts = []
    for s in range(n_splits):
        keyed = df.withColumn("__h", row_hash(key if key else default_key(df), seed + s))
        ranked = hash_rank(keyed, "__h", out="__rn")
        parts.append(ranked.withColumn("split_id", F.lit(s))
                     .withColumn("role", F.when(F.col("__rn") <= n_val, "val").otherwise("train"))
                     .drop("__h", "__rn"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complete_rows(df: DataFrame, target: str, label: str = SPLIT_COL) -> DataFrame:
    """rows with no null in ANY column (features, target, split label) — computed before
    non-numeric columns are discarded, as the reference does."""
    return df.na.drop("any")


def target_profile_df(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """C03 + C07 as a lazy query: per target the non-null count, exact distinct count, whether a
    float value is fractional, the detected task and whether stratification is allowed."""
    parts = []
    for t in targets:
        y = q(t)
        num = isinstance(df.schema[t].dataType, NUMERIC_TYPES)
        frac = (F.coalesce(F.max(y.cast("double") % 1 != 0), F.lit(False)) if _is_float(df, t) else F.lit(False))
        nd = F.count_distinct(y)
        task = (F.when(F.lit(not num), "classification").when(frac, "regression")
                 .when(nd < 20, "classification").otherwise("regression"))
        ok = (F.count(y) >= 2) & (nd >= 2) & (nd < 20) & ~frac
        parts.append(df.agg(F.lit(t).alias("target"), F.count(y).cast("long").alias("n"),
                            nd.cast("long").alias("n_distinct"), frac.alias("fractional"), task.alias("task"),
                            ok.alias("stratify_ok")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
