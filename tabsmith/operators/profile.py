"""Profiling queries (E01–E14). Every result is a long DataFrame: one row per column, per
(column, bucket) or per (column, column).

Scale notes: moments, counts and extremes of all columns are computed in ONE aggregate whose
partial buffers are combined map-side, so the data is scanned once and only a row per task
crosses the network. Per-value work (distinct counts, value counts) goes through an unpivot
and a pre-aggregated ``groupBy`` so no value set is held by one task. Top-k per column uses
``row_number() <= k``, which Spark executes with a partial group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import (
    categorical_columns,
    long_numeric,
    long_strings,
    numeric_columns,
    q,
    quantile_expr,
    row_hash,
    default_key,
)
from tabsmith.functions.ranking import near_first
from tabsmith.functions.stats import (
    column_quantiles,
    grouped_quantiles,
    moments,
    quantile_frame,
    quantile_mode,
    pairwise_corr,
    pairwise_corr_values,
    sample_kurtosis,
    sample_skewness,
    skew_kurt,
)


def _stats_struct(c: str, probs=(0.25, 0.5, 0.75), exact: bool = True, with_q: bool = True) -> Column:
    x = q(c).cast("double")
    fields = [F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
              F.min(x).alias("min"), F.max(x).alias("max")]
    if with_q:
        fields.append(quantile_expr(x, probs, exact).alias("qs"))
    return F.struct(*fields)


def _wide_to_long(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One aggregate producing an array of per-column structs, then ``inline`` to rows."""
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def _stats_long(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """Per-column moments and quantiles. In the session's ``selection`` (default) and ``distributed`` quantile
    modes no task holds a column's values; the quantiles are joined on as a one-row-per-column table."""
    if exact and quantile_mode(df.sparkSession) in ("selection", "distributed"):
        long = _wide_to_long(df, [_stats_struct(c, probs, exact, with_q=False) for c in cols])
        return long.join(F.broadcast(quantile_frame(df, cols, probs)), "column")
    return _wide_to_long(df, [_stats_struct(c, probs, exact) for c in cols])


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, std (ddof 1), min, max, median, q25, q75 per numeric column; empty columns skipped."""
    cols = list(columns) if columns else numeric_columns(df, include_bool=True)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, mean double, std double, min double, max double, "
                                                   "median double, q25 double, q75 double")
    long = _stats_long(df, cols, exact=exact)
    return long.where("n > 0").select(
        "column",
        F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"),
        F.round("min", 4).alias("min"),
        F.round("max", 4).alias("max"),
        F.round(F.col("qs")[1], 4).alias("median"),
        F.round(F.col("qs")[0], 4).alias("q25"),
        F.round(F.col("qs")[2], 4).alias("q75"),
    )


def _edge(first: Column, step: Column, last: Column, i: Column, n: int) -> Column:
    """NumPy ``linspace`` edge i: i*step + first, the last edge exactly ``last``."""
    return F.when(i >= n, last).otherwise(i.cast("double") * step + first)


def histogram_bins(values: DataFrame, bins: int = 20, group: str = "column", value: str = "value",
                   constant_pad: float = 0.5, single_group: str | None = None) -> DataFrame:
    """NumPy-compatible equal-width histogram per group over long (group, value) rows.

    Edges are NumPy's ``linspace`` values; bins are left-closed and the last one closed, so a
    value's bin is the number of interior edges <= value (what NumPy's edge corrections
    guarantee). A constant group spans [v - pad, v + pad]. Returns group, bin, lo, hi, count
    with every bin present (empty bins count 0)."""
    v = values.where(F.col(value).isNotNull())
    rng = v.groupBy(group).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))
    rng = rng.select(
        group,
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - constant_pad).otherwise(F.col("mn")).alias("first"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + constant_pad).otherwise(F.col("mx")).alias("last"),
    ).withColumn("step", (F.col("last") - F.col("first")) / bins)
    if single_group is not None:
        # one group: its range as scalar subqueries (a join on a constant key would be a cross join)
        j = v.withColumns({"first": rng.select("first").scalar(), "last": rng.select("last").scalar(),
                           "step": rng.select("step").scalar()})
    else:
        # one row per group: bounded by the number of columns, so broadcast
        j = v.join(F.broadcast(rng.select(group, "first", "last", "step")), on=group)
    x, first, last, step = F.col(value), F.col("first"), F.col("last"), F.col("step")
    # first estimate, then one correction against the neighbouring linspace edges (plain
    # arithmetic, code-generated; equals counting the interior edges <= x)
    j = j.withColumn("__i", F.least(F.floor((x - first) / (last - first) * bins).cast("int"), F.lit(bins - 1)))
    i = F.col("__i")
    lo_e = i.cast("double") * step + first
    hi_e = F.when(i + 1 >= bins, last).otherwise((i + 1).cast("double") * step + first)
    b = (F.when(x < lo_e, i - 1).when((x >= hi_e) & (i != bins - 1), i + 1).otherwise(i))
    counts = j.select(group, b.alias("bin")).groupBy(group, "bin").agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select(group, "first", "last", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if single_group is not None:
        out = spine.drop(group).join(counts.drop(group), on="bin", how="left").withColumn(group, F.lit(single_group))
    else:
        out = spine.join(counts, on=[group, "bin"], how="left")
    first, last, step, bc = F.col("first"), F.col("last"), F.col("step"), F.col("bin")
    return out.select(
        group,
        bc.alias("bin"),
        F.round(_edge(first, step, last, bc, bins), 4).alias("lo"),
        F.round(_edge(first, step, last, bc + 1, bins), 4).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def histogram(df: DataFrame, bins: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """20-bin histogram of every numeric column (long: column, bin, lo, hi, count)."""
    cols = list(columns) if columns else numeric_columns(df, include_bool=True)
    return histogram_bins(long_numeric(df, cols), bins)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair (diagonal included), 4 dp.

    Two aggregates over the data (means, then mean-shifted cross products; see
    ``pairwise_corr_values``); the p x p result is finalised on the driver (bounded by the
    number of columns)."""
    cols = list(columns) if columns else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    vals = pairwise_corr_values(df, pairs, cols) if pairs else {}
    rows = []
    for (a, b), r in vals.items():
        rows.append((a, b, r))
        if a != b:
            rows.append((b, a, r))
    out = df.sparkSession.createDataFrame(rows, "col_x string, col_y string, r double")
    return out.select("col_x", "col_y", F.round("r", 4).alias("r"))


def missing_values(df: DataFrame) -> DataFrame:
    """Null count and percentage (2 dp) per column."""
    cols = df.columns
    structs = [F.struct(F.lit(c).alias("column"), F.count_if(q(c).isNull()).cast("long").alias("count")) for c in cols]
    return (df.agg(F.count(F.lit(1)).alias("total"), F.array(*structs).alias("s"))
              .select("total", F.inline("s"))
              .select("column", "count",
                      F.when(F.col("total") > 0, F.round(F.col("count") / F.col("total") * 100, 2))
                       .otherwise(F.lit(0.0)).alias("pct")))


def iqr_bounds(df: DataFrame, cols: Sequence[str], exact: bool = True, k: float = 1.5) -> DataFrame:
    """One row per column: q1, q3, lower = q1 - k*IQR, upper = q3 + k*IQR (unrounded)."""
    if exact and quantile_mode(df.sparkSession) in ("selection", "distributed"):
        b = quantile_frame(df, cols, (0.25, 0.75))
    else:
        structs = [F.struct(F.lit(c).alias("column"), quantile_expr(q(c).cast("double"), (0.25, 0.75), exact).alias("qs"))
                   for c in cols]
        b = _wide_to_long(df, structs)
    b = b.select("column", F.col("qs")[0].alias("q1"), F.col("qs")[1].alias("q3"))
    return b.select("column", "q1", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                    (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))


def outliers(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """IQR fences and the count of values outside them, per numeric column."""
    cols = list(columns) if columns else numeric_columns(df)
    bounds = iqr_bounds(df, cols, exact)
    long = long_numeric(df, cols)
    flagged = long.join(F.broadcast(bounds.select("column", "lower", "upper")), on="column")
    counts = flagged.groupBy("column").agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).cast("long").alias("n_outliers"))
    return bounds.join(counts, on="column", how="left").select(
        "column", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"),
        F.coalesce("n_outliers", F.lit(0)).cast("long").alias("n_outliers"))


def scatter(df: DataFrame, x: str, y: str, target: str | None = None, n: int = 500, seed: int = 42,
            key: Sequence[str] | None = None) -> DataFrame:
    """Up to ``n`` points with x, y (and target) non-null, chosen by the smallest row digests."""
    need = [c for c in (x, y, target) if c]
    k = row_hash(key if key else default_key(df), seed)
    base = df.na.drop(subset=need).withColumn("__h", k)
    pts = base.orderBy("__h").limit(n)
    sel = [F.round(q(x).cast("double"), 4).alias("x"), F.round(q(y).cast("double"), 4).alias("y")]
    if target:
        sel.append(q(target).alias("color"))
    return pts.select(*sel)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) of non-null values, pre-aggregated map-side."""
    return (long_strings(df, cols).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).cast("long").alias("count")))


def categorical_stats(df: DataFrame, k: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count and top-k values (count desc, value asc) per categorical column."""
    cols = list(columns) if columns else categorical_columns(df)
    vc = value_counts(df, cols)
    n_unique = vc.groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_unique"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    top = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(F.broadcast(n_unique), on="column").select("column", "n_unique", "value", "count",
                                                               F.col("rank").cast("int").alias("rank"))


def health_summary(df: DataFrame) -> DataFrame:
    """Rows, columns and duplicate rows beyond the first occurrence (null equals null).

    Duplicates come from a ``groupBy`` on all columns whose partial aggregation collapses
    copies map-side, so a heavily duplicated row costs nothing extra at the shuffle."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    dup = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                     F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n_rows"))
    return dup.select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"), "n_duplicates")


def distinct_counts(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """(column, n_distinct) excluding nulls. Numbers are compared in their own type (a double can't
    tell longs above 2^53 apart), everything else by its string form."""
    parts, kinds = [], {}
    for c in num_cols:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for cols in kinds.values():
        long = df.select(*[q(c) for c in cols]).unpivot([], cols, "column", "value")
        parts.append(long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("one")).select("column"))
    if cat_cols:
        parts.append(long_strings(df, cat_cols).where(F.col("value").isNotNull())
                     .groupBy("column", "value").agg(F.lit(1).alias("one")).select("column"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_distinct"))


def dtype_summary(df: DataFrame) -> DataFrame:
    """E08e: per data type its kind (numeric, categorical or other), number of columns, their names in order
    and the number of their non-null values; one aggregate."""
    num, cat = numeric_columns(df), categorical_columns(df)
    by: dict[str, list[str]] = {}
    for f in df.schema.fields:
        kind = "numeric" if f.name in num else "categorical" if f.name in cat else "other"
        by.setdefault((f.dataType.simpleString(), kind), []).append(f.name)
    structs = [F.struct(F.lit(t).alias("dtype"), F.lit(kind).alias("kind"), F.lit(len(own)).cast("long").alias("n_columns"), F.lit(",".join(own)).alias("columns"),
                        sum((F.count(q(c)) for c in own[1:]), F.count(q(own[0]))).cast("long").alias("n_values")) for (t, kind), own in by.items()]
    return _wide_to_long(df, structs)


def health_columns(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """E08b–E08d: per column kind, distinct count, constant / near-constant / high-cardinality
    flags, completeness % (1 dp) and variance (ddof 1, ``digits`` decimals, None for all; 0 below two
    values)."""
    num = numeric_columns(df)
    cat = [c for c in df.columns if c not in num and c in categorical_columns(df)]
    structs = [F.struct(F.lit(c).alias("column"), F.count(q(c)).alias("nn"),
                        (F.var_samp(q(c).cast("double")) if c in num else F.lit(None).cast("double")).alias("var"))
               for c in num + cat]
    per = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*structs).alias("s")).select("n_rows", F.inline("s"))
    nd = distinct_counts(df, num, cat)
    j = per.join(nd, on="column", how="left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("long"))
    is_num = F.col("column").isin(num) if num else F.lit(False)
    rows = F.col("n_rows")
    near_cap = F.greatest(F.lit(2), F.floor(rows * 0.01).cast("long"))
    return j.select(
        "column",
        F.when(is_num, F.lit("numeric")).otherwise(F.lit("categorical")).alias("kind"),
        "n_distinct",
        (is_num & (F.col("n_distinct") <= 1)).alias("is_constant"),
        (is_num & (F.col("n_distinct") > 1) & (F.col("n_distinct") <= near_cap)).alias("is_near_constant"),
        ((~is_num) & (rows > 0) & (F.col("n_distinct") / rows > 0.5)).alias("is_high_card"),
        F.when(rows > 0, F.round((1 - (rows - F.col("nn")) / rows) * 100, 1)).otherwise(F.lit(100.0)).alias("completeness"),
        F.when(is_num, F.when(F.col("nn") > 1, F.col("var") if digits is None else F.round("var", digits)).otherwise(F.lit(0.0))).alias("variance"),
    )


def _skew_hint(skew: Column) -> Column:
    return (F.when(F.abs(skew) < 0.5, F.lit(None).cast("string"))
             .when(skew > 2, F.lit("log1p (strong right skew)"))
             .when(skew > 0.5, F.lit("sqrt (moderate right skew)"))
             .when(skew < -2, F.lit("square / reciprocal (strong left skew)"))
             .otherwise(F.lit("sqrt or reflect + log1p (moderate left skew)")))


def target_numeric(df: DataFrame, target: str, exact: bool = True) -> DataFrame:
    """One row describing a numeric target, with a transform hint from its skewness."""
    y = q(target).cast("double")
    s = df.agg(
        F.count(y).cast("long").alias("n"),
        sample_skewness(y).alias("skewness"),
        sample_kurtosis(y).alias("kurtosis"),
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
    ).withColumn("median", F.lit(column_quantiles(df.select(y.alias("y")), ["y"], (0.5,), exact)["y"][0]).cast("double"))
    return s.select(
        F.lit(target).alias("target_col"), "n",
        *[F.round(c, 4).alias(c) for c in ("skewness", "kurtosis", "mean", "std", "min", "max", "median")],
        _skew_hint(F.col("skewness")).alias("transform_hint"))


def target_histogram(df: DataFrame, target: str, bins: int = 20) -> DataFrame:
    """The histogram of a numeric target, as E02's."""
    return histogram(df.select(q(target)), bins)


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Class counts and shares, number of classes, imbalance = max/min count, flag > 3."""
    vc = value_counts(df, [target]).select(F.col("value").alias("class"), "count")
    total = vc.agg(F.sum("count")).scalar()
    n_classes = vc.agg(F.count(F.lit(1)).cast("long")).scalar()
    imb = F.when(n_classes > 1, F.round(vc.agg(F.max("count")).scalar() / vc.agg(F.min("count")).scalar(), 2)) \
        .otherwise(F.lit(1.0))
    return vc.select(
        "class", "count", F.round(F.col("count") / total * 100, 2).alias("pct"), n_classes.alias("n_classes"),
        imb.alias("imbalance_ratio"), (imb > 3.0).alias("is_imbalanced"))


def skew_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skewness, kurtosis, |skew|, severity and hint per numeric column with >= 3 values.

    Two aggregates over the data (means, then powers of mean-shifted values); the per-column
    result (bounded by the number of columns) is finalised on the driver."""
    cols = list(columns) if columns else numeric_columns(df)
    mom = moments(df, cols) if cols else {}
    rows = []
    for c in cols:
        if mom[c]["n"] < 3:
            continue
        g1, g2 = skew_kurt(mom[c])
        rows.append((c, g1, g2))
    long = df.sparkSession.createDataFrame(rows, "column string, skew double, kurt double")
    sk = F.round("skew", 4)
    a = F.abs(F.col("skew"))
    return long.select(
        "column", sk.alias("skewness"), F.round("kurt", 4).alias("kurtosis"), F.round(a, 4).alias("abs_skewness"),
        F.when(a < 0.5, "normal").when(a < 1.0, "moderate").otherwise("high").alias("severity"),
        F.when(a < 0.5, F.lit(None).cast("string"))
         .when(a < 1.0, F.when(F.col("skew") > 0, "sqrt").otherwise("square"))
         .otherwise(F.when(F.col("skew") > 0, "log1p").otherwise("reciprocal")).alias("hint"),
    )


def box_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Min, q1, median, mean, q3, max and 1.5 IQR fences of each column."""
    cols = list(columns) if columns else numeric_columns(df)
    long = _stats_long(df, cols, exact=exact).where("n > 0")
    q1, med, q3 = F.col("qs")[0], F.col("qs")[1], F.col("qs")[2]
    return long.select(
        "column", F.round("min", 4).alias("min"), F.round(q1, 4).alias("q1"), F.round(med, 4).alias("median"),
        F.round("mean", 4).alias("mean"), F.round(q3, 4).alias("q3"), F.round("max", 4).alias("max"),
        F.round(q1 - 1.5 * (q3 - q1), 4).alias("lower_fence"), F.round(q3 + 1.5 * (q3 - q1), 4).alias("upper_fence"))


def box_outliers(df: DataFrame, columns: Sequence[str] | None = None, n: int = 60,
                 seed: int = 42, key: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Up to ``n`` out-of-fence values per column, chosen by the smallest row digests."""
    cols = list(columns) if columns else numeric_columns(df)
    bounds = iqr_bounds(df, cols, exact)
    keyed = df.withColumn("__h", row_hash(key if key else default_key(df), seed))
    long = long_numeric(keyed, cols, id_cols=["__h"])
    out = long.join(F.broadcast(bounds.select("column", "lower", "upper")), on="column").where(
        (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    w = Window.partitionBy("column").orderBy("__h")
    return (out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
               .select("column", F.round("value", 4).alias("value")))


def _pair_sample(df: DataFrame, columns, max_cols, n, seed, key):
    cols = list(columns) if columns else numeric_columns(df)[:max_cols]
    k = row_hash(key if key else default_key(df), seed)
    samp = df.na.drop(subset=cols).withColumn("__h", k).orderBy("__h").limit(n)
    return cols, samp


def pairplot_points(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int = 6, n: int = 300,
                    seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """E12 off-diagonal cells: sampled complete rows as (col_x, col_y, x, y) points."""
    cols, samp = _pair_sample(df, columns, max_cols, n, seed, key)
    structs = [F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"),
                        F.round(q(a).cast("double"), 4).alias("x"), F.round(q(b).cast("double"), 4).alias("y"))
               for a in cols for b in cols if a != b]
    return samp.select(F.inline(F.array(*structs)))


def pairplot_hist(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int = 6, n: int = 300,
                  seed: int = 42, key: Sequence[str] | None = None, bins: int = 15) -> DataFrame:
    """E12 diagonal cells: 15-bin histogram of each column over the sample."""
    cols, samp = _pair_sample(df, columns, max_cols, n, seed, key)
    return histogram_bins(long_numeric(samp, cols), bins)


def feature_target_numeric(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per feature, on rows where feature and target are non-null: Pearson r, OLS slope
    and intercept, and the trend end points at the feature's min / max (no trend if constant)."""
    cols = [c for c in (list(columns) if columns else numeric_columns(df)) if c != target]
    y = q(target).cast("double")
    structs = []
    for c in cols:
        x = q(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        xx = F.when(both, x)
        yy = F.when(both, y)
        structs.append(F.struct(
            F.lit(c).alias("column"), F.count(xx).alias("n"), pairwise_corr(x, y).alias("r"),
            F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
            F.min(xx).alias("x_min"), F.max(xx).alias("x_max"), F.stddev_pop(xx).alias("sd")))
    long = _wide_to_long(df, structs).where("n > 0")
    has = F.col("sd") > 0
    return long.select(
        "column", F.round("r", 4).alias("correlation"),
        F.when(has, F.round("slope", 6)).alias("slope"),
        F.when(has, F.round("intercept", 4)).alias("intercept"),
        F.when(has, F.round("x_min", 4)).alias("trend_x0"), F.when(has, F.round("x_max", 4)).alias("trend_x1"),
        F.when(has, F.round(F.col("slope") * F.col("x_min") + F.col("intercept"), 4)).alias("trend_y0"),
        F.when(has, F.round(F.col("slope") * F.col("x_max") + F.col("intercept"), 4)).alias("trend_y1"),
    )


def feature_target_points(df: DataFrame, target: str, columns: Sequence[str] | None = None, n: int = 400, seed: int = 42,
                          key: Sequence[str] | None = None) -> DataFrame:
    """Per feature up to ``n`` points (column, x, y) with feature and target non-null, those with the smallest
    row digests. The rows near each feature's boundary digest are told by a comparison; only they are sorted."""
    cols = [c for c in (list(columns) if columns else numeric_columns(df)) if c != target]
    keyed = df.withColumn("__h", row_hash(key if key else default_key(df), seed)).withColumn("__y", q(target).cast("double"))
    long = long_numeric(keyed.where(F.col("__y").isNotNull()), cols, id_cols=["__h", "__y"]).where(F.col("value").isNotNull())
    near = near_first(long, "__h", {c: n for c in cols}, "column")
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy("column").orderBy("__h"))).where(F.col("__r") <= n)
    return ranked.select("column", F.round("value", 4).alias("x"), F.round("__y", 4).alias("y"))


def feature_target_classes(df: DataFrame, target: str, columns: Sequence[str] | None = None, max_classes: int | None = None,
                           exact: bool = True) -> DataFrame:
    """Per numeric feature and class q1, median, mean, q3, min and max over rows where the
    feature is non-null. ``max_classes`` keeps the first class names in order; default all."""
    cols = [c for c in (list(columns) if columns else numeric_columns(df)) if c != target]
    cls = q(target).cast("string")
    base = df.where(cls.isNotNull()).select(cls.alias("class"), *[q(c) for c in cols])
    if max_classes is not None:
        first = base.select("class").distinct().orderBy("class").limit(max_classes)
        base = base.join(first, "class", "left_semi")
    long = long_numeric(base, cols, id_cols=["class"]).where(F.col("value").isNotNull())
    if exact and quantile_mode(df.sparkSession) in ("selection", "distributed"):
        # one class may hold most rows: exact quantiles without a per-group value set in one task
        key = F.concat_ws("\u0001", F.col("column"), F.col("class"))
        qs = grouped_quantiles(long.withColumn("__k", key), "__k", "value", (0.25, 0.5, 0.75))
        qf = df.sparkSession.createDataFrame([(k.split("\u0001")[0], k.split("\u0001")[1], v) for k, v in qs.items()],
                                             "column string, class string, qs array<double>")
        g = long.groupBy("column", "class").agg(F.avg("value").alias("mean"), F.min("value").alias("min"),
                                                F.max("value").alias("max")).join(F.broadcast(qf), ["column", "class"])
        return g.select("column", "class", F.round(F.col("qs")[0], 4).alias("q1"),
                        F.round(F.col("qs")[1], 4).alias("median"), F.round("mean", 4).alias("mean"),
                        F.round(F.col("qs")[2], 4).alias("q3"), F.round("min", 4).alias("min"),
                        F.round("max", 4).alias("max"))
    g = long.groupBy("column", "class").agg(
        quantile_expr(F.col("value"), (0.25, 0.5, 0.75), exact).alias("qs"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return g.select("column", "class", F.round(F.col("qs")[0], 4).alias("q1"), F.round(F.col("qs")[1], 4).alias("median"),
                    F.round("mean", 4).alias("mean"), F.round(F.col("qs")[2], 4).alias("q3"),
                    F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


def top_correlated(df: DataFrame, target: str, k: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """The k features with the largest |r| against the target (null r counts as 0)."""
    k = max(1, min(int(k), 20))
    cols = [c for c in (list(columns) if columns else numeric_columns(df)) if c != target]
    vals = pairwise_corr_values(df, [(c, target) for c in cols], cols + [target]) if cols else {}
    rows = [(c, None if vals[(c, target)] is None else round(vals[(c, target)], 4)) for c in cols]
    rows.sort(key=lambda t: (-abs(t[1] or 0.0), t[0]))
    top = [(c, r, i + 1) for i, (c, r) in enumerate(rows[:k])]
    return df.sparkSession.createDataFrame(top, "column string, r double, rank int")
