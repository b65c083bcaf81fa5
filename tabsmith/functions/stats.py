"""Moment corrections and safe statistics shared by the profile, step and metric operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness G1 (pandas ``Series.skew``): 0 for a constant, null below 3 values."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)  # population g1, null when the variance is 0
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.var_pop(c) == 0, F.lit(0.0))
             .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``Series.kurtosis``): 0 for a constant, null below 4."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)  # population excess kurtosis
    return (F.when(n < 4, F.lit(None).cast("double"))
             .when(F.var_pop(c) == 0, F.lit(0.0))
             .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def pairwise_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are non-null; null when undefined (never raises under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    den = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.try_divide(F.covar_pop(xx, yy), F.when(den != 0, den))


def _means(df, cols):
    """Pass 1: row count, non-null count and mean of each column (one aggregate)."""
    from tabsmith.functions.columns import q

    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        exprs += [F.count(q(c)).alias(f"c{i}"), F.avg(q(c).cast("double")).alias(f"m{i}")]
    r = df.agg(*exprs).first()
    return r["__n"], [r[f"c{i}"] for i in range(len(cols))], [r[f"m{i}"] for i in range(len(cols))]


def pairwise_corr_values(df, pairs, cols=None) -> dict:
    """Pearson r of every (a, b) pair over rows where both are non-null, by the two-pass
    method: pass 1 the means, pass 2 sums of mean-shifted products (plain sums, combined
    map-side). Null-free pairs share per-column sums; pairs touching a column with nulls get
    masked sums. Returns {(a, b): r or None}; all work is two aggregates over the data."""
    from tabsmith.functions.columns import q

    cols = cols or sorted({c for p in pairs for c in p})
    idx = {c: i for i, c in enumerate(cols)}
    n, counts, means = _means(df, cols)
    full = {c for c in cols if counts[idx[c]] == n}
    d = {c: q(c).cast("double") - F.lit(means[idx[c]] if means[idx[c]] is not None else 0.0) for c in cols}
    exprs = {}
    for c in full:
        exprs[f"s_{idx[c]}"] = F.sum(d[c])
        exprs[f"ss_{idx[c]}"] = F.sum(d[c] * d[c])
    for a, b in pairs:
        ia, ib = idx[a], idx[b]
        if a in full and b in full:
            exprs[f"x_{ia}_{ib}"] = F.sum(d[a] * d[b])
        else:
            both = q(a).isNotNull() & q(b).isNotNull()
            da, db = F.when(both, d[a]), F.when(both, d[b])
            exprs[f"n_{ia}_{ib}"] = F.count_if(both)
            exprs[f"a_{ia}_{ib}"] = F.sum(da)
            exprs[f"b_{ia}_{ib}"] = F.sum(db)
            exprs[f"aa_{ia}_{ib}"] = F.sum(da * da)
            exprs[f"bb_{ia}_{ib}"] = F.sum(db * db)
            exprs[f"x_{ia}_{ib}"] = F.sum(da * db)
    r = df.agg(*[e.alias(k) for k, e in exprs.items()]).first() if exprs else {}
    out = {}
    for a, b in pairs:
        ia, ib = idx[a], idx[b]
        if a in full and b in full:
            m, sa, sb, saa, sbb = n, r[f"s_{ia}"], r[f"s_{ib}"], r[f"ss_{ia}"], r[f"ss_{ib}"]
        else:
            m, sa, sb, saa, sbb = (r[f"n_{ia}_{ib}"], r[f"a_{ia}_{ib}"], r[f"b_{ia}_{ib}"], r[f"aa_{ia}_{ib}"],
                                   r[f"bb_{ia}_{ib}"])
        sab = r[f"x_{ia}_{ib}"]
        if not m or sab is None:
            out[(a, b)] = None
            continue
        cov = sab / m - (sa / m) * (sb / m)
        va = saa / m - (sa / m) ** 2
        vb = sbb / m - (sb / m) ** 2
        den = (va * vb) ** 0.5 if va > 0 and vb > 0 else 0.0
        out[(a, b)] = None if den == 0 else max(-1.0, min(1.0, cov / den))
    return out


def moments(df, cols) -> dict:
    """Per column: n, mean and the central moments m2, m3, m4 (population) by the two-pass
    method (pass 2 sums powers of mean-shifted values)."""
    from tabsmith.functions.columns import q

    n_rows, counts, means = _means(df, cols)
    exprs = []
    for i, c in enumerate(cols):
        dd = q(c).cast("double") - F.lit(means[i] if means[i] is not None else 0.0)
        exprs += [F.sum(dd).alias(f"s1_{i}"), F.sum(dd * dd).alias(f"s2_{i}"), F.sum(dd * dd * dd).alias(f"s3_{i}"),
                  F.sum(dd * dd * dd * dd).alias(f"s4_{i}")]
    r = df.agg(*exprs).first() if exprs else {}
    out = {}
    for i, c in enumerate(cols):
        n = counts[i]
        if not n:
            out[c] = {"n": 0, "mean": None, "m2": None, "m3": None, "m4": None}
            continue
        e1, e2, e3, e4 = (r[f"s{k}_{i}"] / n for k in (1, 2, 3, 4))
        m2 = e2 - e1 * e1
        m3 = e3 - 3 * e1 * e2 + 2 * e1 ** 3
        m4 = e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 ** 4
        out[c] = {"n": n, "mean": means[i], "m2": m2, "m3": m3, "m4": m4}
    return out


def skew_kurt(mom: dict):
    """Bias-corrected (G1, G2) from population moments, as pandas: 0 for a constant, None when
    there are too few values."""
    n, m2, m3, m4 = mom["n"], mom["m2"], mom["m3"], mom["m4"]
    if n is None or n < 3 or m2 is None:
        return None, None
    if m2 <= 1e-14 * max(1.0, abs(mom["mean"] or 0.0)) ** 2:
        return 0.0, (0.0 if n >= 4 else None)
    g1 = m3 / m2 ** 1.5
    G1 = g1 * (n * (n - 1)) ** 0.5 / (n - 2)
    G2 = None
    if n >= 4:
        g2 = m4 / (m2 * m2) - 3
        G2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return G1, G2


QUANTILE_CONF = "tabsmith.quantiles"  # selection (default) | distributed | exact | approx

#: Bins that a pass of the selection gathers at most, over all groups; bins of one interval, at least and most.
PASS_BINS, LEAST_BINS, MOST_BINS = 200_000, 16, 2048
#: Rows of a pass's intervals that are broadcast.
SMALL_ROWS = 100_000


def quantile_mode(spark) -> str:
    """How quantiles are computed, read from the session. ``selection``: exact, by histograms that close in on
    the wanted ranks (no value set anywhere, no shuffle of values). ``distributed``: exact, from pre-aggregated
    value counts and two-phase cumulative counts. ``exact``: Spark's ``percentile``, whose memory grows with a
    column's distinct values in one task. ``approx``: the bounded ``percentile_approx`` sketch."""
    return (spark.conf.get(QUANTILE_CONF, "selection") or "selection").lower()


def _ranks(n: int, probs) -> list[int]:
    """The 0-based ranks between which the quantiles of ``n`` values lie."""
    return sorted({int(r) for p in probs for r in (p * (n - 1) // 1, -(-p * (n - 1) // 1))})


def _between(n: int, probs, at) -> list[float]:
    """Linear interpolation between the values ``at`` two ranks."""
    out = []
    for p in probs:
        x = p * (n - 1)
        a, b = at(int(x // 1)), at(int(-(-x // 1)))
        out.append(a + (b - a) * (x - int(x // 1)))
    return out


def selected_quantiles(long, group: str, value: str, probs) -> dict:
    """Exact linear-interpolated quantiles of ``value`` for every ``group`` of a long frame, as
    :func:`grouped_quantiles`, by selection.

    A pass counts, for all groups and ranks together, the values in equal bins of the intervals that hold the
    wanted ranks, with the least and greatest value of each bin; the bin that holds a rank is its next
    interval, until that is a single value. Counts are combined map-side, so a pass moves bins and never
    values. Each pass divides an interval by up to ``MOST_BINS``: two or three do for most columns; only
    values spread over many orders of magnitude take more. Nulls and NaN aren't values."""
    v = long.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, open_, found = {}, {}, {}
    for r in v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        n[r["g"]] = r["n"]
        open_[r["g"]] = [(r["lo"], r["hi"], 0, _ranks(r["n"], probs))]
    while True:
        for g, own in list(open_.items()):
            for lo, hi, _, ranks in own:
                if lo == hi:
                    found.update({(g, rank): lo for rank in ranks})
            open_[g] = [x for x in own if x[0] != x[1]]
        rows = [(g, k, float(x[0]), float(x[1])) for g, own in open_.items() for k, x in enumerate(own)]
        if not rows:
            return {g: _between(count, probs, lambda rank, g=g: found[g, rank]) for g, count in n.items()}
        bins = max(LEAST_BINS, min(MOST_BINS, PASS_BINS // len(rows)))
        asked = long.sparkSession.createDataFrame(rows, f"g {v.schema['g'].dataType.simpleString()}, k int, lo double, hi double")
        asked = F.broadcast(asked) if len(rows) <= SMALL_ROWS else asked
        met = v.join(asked, "g").where("v >= lo AND v <= hi")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        place = F.when(F.col("v") == F.col("hi"), bins - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
        counted = met.groupBy("g", "k", F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        before: dict = {}
        after: dict = {g: [] for g in open_}
        for r in sorted(counted, key=lambda r: r["lo"]):
            _, _, base, ranks = open_[r["g"]][r["k"]]
            start = before.get((r["g"], r["k"]), base)
            before[r["g"], r["k"]] = start + r["c"]
            if inside := [x for x in ranks if start <= x < start + r["c"]]:
                after[r["g"]].append((r["lo"], r["hi"], start, inside))
        open_ = after


def grouped_quantiles(long, group: str, value: str, probs) -> dict:
    """Exact linear-interpolated quantiles (pandas / ``quantile_cont``) of ``value`` for every
    ``group`` of a long frame, without holding any group's value set in one task.

    1. non-null counts per group (one aggregate; bounded by the number of groups);
    2. (group, value, count) by a pre-aggregated ``groupBy``;
    3. cumulative counts per group over sorted values with ``ordered_cumsum`` (bucketed);
    4. each distinct value row keeps the wanted positions inside its run of equal values (a
       small per-group position array, filtered per row), so only groups x probs x 2 values
       reach the driver.
    Returns {group: [q(p) for p in probs]} for groups with at least one value."""
    from tabsmith.functions.ranking import ordered_cumsum

    if quantile_mode(long.sparkSession) == "selection":
        return selected_quantiles(long, group, value, probs)
    v = long.select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    n = {r["__g"]: r["n"] for r in v.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {}
    for g, cnt in n.items():
        want[g] = _ranks(cnt, probs)
    if not want:
        return {}
    vc = v.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("c"))
    cum = ordered_cumsum(vc, "__v", {"cum": F.col("c")}, groups=["__g"])
    targets = F.create_map(*[x for g, ps in want.items() for x in (F.lit(g), F.array(*[F.lit(t) for t in ps]))])
    hit = cum.select("__g", "__v", F.filter(F.element_at(targets, F.col("__g")),
                                            lambda t: (t >= F.col("cum") - F.col("c")) & (t < F.col("cum"))).alias("pos"))
    got = {}
    for r in hit.where(F.size("pos") > 0).select("__g", "__v", F.explode("pos").alias("p")).collect():
        got[(r["__g"], r["p"])] = r["__v"]
    out = {}
    for g, cnt in n.items():
        out[g] = _between(cnt, probs, lambda rank, g=g: got[g, rank])
    return out


def distributed_quantiles(df, cols, probs) -> dict:
    """Exact quantiles of each column (see ``grouped_quantiles``; the group is the column)."""
    from tabsmith.functions.columns import long_numeric

    got = grouped_quantiles(long_numeric(df, cols), "column", "value", probs)
    return {c: got.get(c, [None] * len(probs)) for c in cols}


def column_quantiles(df, cols, probs, exact: bool = True) -> dict:
    """{column: [quantiles]} by the session's quantile mode (``exact=False`` forces the sketch)."""
    from tabsmith.functions.columns import q, quantile_expr

    cols = list(cols)
    if not cols:
        return {}
    mode = quantile_mode(df.sparkSession) if exact else "approx"
    if mode in ("selection", "distributed"):
        return distributed_quantiles(df, cols, probs)
    r = df.agg(*[quantile_expr(q(c).cast("double"), probs, mode != "approx").alias(c) for c in cols]).first()
    return {c: (list(r[c]) if r[c] is not None else [None] * len(probs)) for c in cols}


def quantile_frame(df, cols, probs, exact: bool = True):
    """The same as a small DataFrame (column, qs array<double>), one row per column."""
    vals = column_quantiles(df, cols, probs, exact)
    return df.sparkSession.createDataFrame([(c, [None if v is None else float(v) for v in vals[c]]) for c in cols],
                                           "column string, qs array<double>")
