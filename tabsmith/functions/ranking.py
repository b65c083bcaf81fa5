"""Global ranks without a single-task window.

A window with no PARTITION BY moves every row to one task. These helpers compute the same
integers in two phases:

* ``hash_rank``: the order key is an md5 hex digest, whose leading hex digits split rows into
  ordered, evenly filled buckets. Phase 1 counts rows per (group, bucket) — a small table —
  and turns the counts into offsets; phase 2 numbers rows inside each (group, bucket) and adds
  the offset. Equal to ``row_number() over (partition by group order by digest)``.
* ``ordered_cumsum``: running sums over a numeric key via value buckets (bounds from an
  approximate quantile sketch), per-bucket totals and bucket offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 4  # 65,536 ordered buckets


def bucket_digits(n_rows: int | None, rows_per_bucket: int = 1_000_000) -> int:
    """Leading hex digits so that a bucket holds at most about ``rows_per_bucket`` rows (2..6);
    4 when the row count is unknown."""
    if not n_rows:
        return BUCKET_HEX_DIGITS
    d = 2
    while d < 6 and n_rows / 16 ** d > rows_per_bucket:
        d += 1
    return d


def hash_rank(df: DataFrame, digest: str, groups: Sequence[str] = (), out: str = "rn",
              hex_digits: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Add ``out`` = row_number() over (partition by groups order by digest) (1-based).
    ``n_rows`` (when known) sizes the buckets (16^2 .. 16^6, about a million rows per bucket at most)."""
    hex_digits = hex_digits or bucket_digits(n_rows)
    g = list(groups)
    b = "__bucket"
    with_b = df.withColumn(b, F.substring(F.col(digest), 1, hex_digits))
    counts = with_b.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*g, b, (F.sum("__n").over(w) - F.col("__n")).alias("__off"))
    # without groups the offsets table has at most 16^hex_digits rows and is broadcast; with
    # groups it has (#groups x buckets) rows, so adaptive execution picks the join by its size
    joined = with_b.join(F.broadcast(offsets) if not g else offsets, on=[*g, b], how="inner")
    wr = Window.partitionBy(*g, b).orderBy(F.col(digest))
    return joined.withColumn(out, (F.row_number().over(wr) + F.col("__off")).cast("long")).drop(b, "__off")


#: Counts of digest prefixes that a pass of the selection gathers at most, and boundaries that are broadcast.
PASS_PREFIXES, SMALL_ROWS = 200_000, 100_000
DIGEST_LENGTH = 32


def digest_boundaries(df: DataFrame, digest: str, wanted: dict, group: str | None = None, slack: int = 0) -> dict:
    """{group: (prefix, ties)}: where the first ``wanted[group]`` rows of each group in ``digest`` order (md5, hex) end.
    They are the rows whose leading digits are smaller than ``prefix``, and of those that have it the
    ``ties`` first, or all for None. The key is None without groups; groups not wanted are left out.

    A selection: each pass counts leading digits of the rows that still share the boundary's, map-side combined,
    and goes on in the one bucket in which the boundary lies, until it ends with a bucket. Rows are not moved
    or sorted. Only repeated digests are ever a tie. With ``slack`` a group ends with the whole bucket that holds its
    boundary as soon as that has at most so many rows: what is below is then a little more than wanted."""
    key = F.col(group) if group else F.lit(None).cast("string")
    now = df.select(key.alias("g"), F.col(digest).alias("d"))
    found = {g: ("", 0) for g, n in wanted.items() if n <= 0}
    open_ = {g: ("", 0) for g, n in wanted.items() if n > 0}  # digits known, rows before them
    while open_:
        digits = max(d for d in (1, 2, 3, 4) if d == 1 or len(open_) * 16 ** d <= PASS_PREFIXES)
        known = len(next(iter(open_.values()))[0])
        if known:
            rows = [(g, prefix) for g, (prefix, _) in open_.items()]
            edge = df.sparkSession.createDataFrame(rows, f"g2 {now.schema['g'].dataType.simpleString()}, prefix string")
            edge = F.broadcast(edge) if len(rows) <= SMALL_ROWS else edge
            met = now.join(edge, F.col("g").eqNullSafe(F.col("g2")) & (F.substring("d", 1, known) == F.col("prefix")), "left_semi")
        else:
            met = now
        size = min(DIGEST_LENGTH, known + digits)
        counts = met.groupBy("g", F.substring("d", 1, size).alias("prefix")).agg(F.count("*").alias("n")).collect()
        before, after = {g: base for g, (_, base) in open_.items()}, {}
        for r in sorted(counts, key=lambda r: r["prefix"]):
            g = r["g"]
            if g not in before:
                continue
            start = before[g]
            before[g] = start + r["n"]
            if start < wanted[g] <= before[g]:
                if before[g] == wanted[g] or r["n"] <= slack:
                    found[g] = (r["prefix"], None)
                elif size == DIGEST_LENGTH:
                    found[g] = (r["prefix"], wanted[g] - start)
                else:
                    after[g] = (r["prefix"], start)
        for g in set(open_) - set(found) - set(after):
            found[g] = ("g" * DIGEST_LENGTH, None)  # fewer rows than wanted: all of them
        open_ = after
    return found


def first_by_digest(df: DataFrame, digest: str, wanted: dict, group: str | None = None, out: str = "first") -> DataFrame:
    """Add ``out``: whether a row is among the first ``wanted[group]`` of its group in ``digest`` order. A comparison
    with the boundary of :func:`digest_boundaries`; only rows that tie with it are numbered."""
    ends = digest_boundaries(df, digest, wanted, group)
    if group:
        rows = [(g, prefix, len(prefix), n) for g, (prefix, n) in ends.items()]
        edge = df.sparkSession.createDataFrame(rows, f"__g {df.schema[group].dataType.simpleString()}, __prefix string, __size int, __ties long")
        df = df.join(F.broadcast(edge) if len(rows) <= SMALL_ROWS else edge, F.col(group).eqNullSafe(F.col("__g")), "left")
    else:
        prefix, n = ends[None]
        df = df.withColumns({"__prefix": F.lit(prefix), "__size": F.lit(len(prefix)), "__ties": F.lit(n).cast("long")})
    lead = F.expr(f"substring(`{digest}`, 1, __size)")
    inside = (lead < F.col("__prefix")) | ((lead == F.col("__prefix")) & F.col("__ties").isNull())
    names = [c for c in df.columns if c not in ("__g", "__prefix", "__size", "__ties")]
    if all(n is None or n == 0 for _, n in ends.values()):
        return df.withColumn(out, F.coalesce(inside, F.lit(False))).select(*[f"`{c}`" for c in names], out)
    tied = (lead == F.col("__prefix")) & (F.col("__ties") > 0)
    rank = F.row_number().over(Window.partitionBy(*([group] if group else []), "__prefix").orderBy(F.col(digest)))
    rest = df.where(~F.coalesce(tied, F.lit(False))).withColumn(out, F.coalesce(inside, F.lit(False)))
    numbered = df.where(tied).withColumn(out, rank <= F.col("__ties"))
    return rest.unionByName(numbered).select(*[f"`{c}`" for c in names], out)


def near_first(df: DataFrame, digest: str, wanted: dict, group: str, slack: int = 100_000) -> DataFrame:
    """The rows of the wanted groups among which their first ``wanted[group]`` in ``digest`` order are, and at most
    ``slack`` more of each (but for rows with one and the same digest): a comparison, so that a rank sorts few rows."""
    ends = digest_boundaries(df, digest, wanted, group, slack)
    if not ends:
        return df.limit(0)
    rows = [(g, prefix) for g, (prefix, _) in ends.items()]
    edge = df.sparkSession.createDataFrame(rows, f"__g {df.schema[group].dataType.simpleString()}, __prefix string")
    edge = F.broadcast(edge) if len(rows) <= SMALL_ROWS else edge
    near = F.expr(f"substring(`{digest}`, 1, length(__prefix))") <= F.col("__prefix")
    return df.join(edge, F.col(group).eqNullSafe(F.col("__g")) & near, "left_semi")


def hash_positions(nodes: DataFrame, digest: str, weight: str, groups: Sequence[str], out: str = "start") -> DataFrame:
    """Add ``out`` = the sum of ``weight`` over the group's rows with a smaller digest. Digests are unique in
    their group. Sums of leading-digit buckets (at most 16^4 a group) are accumulated first, rows only
    inside their bucket."""
    g, b = list(groups), "__bucket"
    dealt = nodes.withColumn(b, F.substring(F.col(digest), 1, BUCKET_HEX_DIGITS))
    sums = dealt.groupBy(*g, b).agg(F.sum(weight).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*g).orderBy(b)) - F.col("__sum")
    inside = F.sum(weight).over(Window.partitionBy(*g, b).orderBy(digest)) - F.col(weight)
    return dealt.join(sums.select(*g, b, before.alias("__off")), [*g, b]).withColumn(out, F.col("__off") + inside).drop(b, "__off")


def ordered_cumsum(df: DataFrame, order_col: str, sums: dict[str, Column], groups: Sequence[str] = (),
                   n_buckets: int | None = None) -> DataFrame:
    """Add inclusive running sums of each ``sums`` expression in ascending ``order_col`` (a numeric
    column, unique within each group) without a global window.

    Bucket bounds come from ``percentile_approx`` (one small action, ``n_buckets`` numbers); the
    bucket of a row is a pure function of its value, so re-executed tasks land rows in the same
    bucket. Per-(group, bucket) totals become offsets, broadcast back, and a window inside each
    bucket adds the local running sum."""
    spark = df.sparkSession
    if n_buckets is None:
        n_buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    g = list(groups)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10_000).alias("b")).first()["b"] or []
    bounds = sorted({float(b) for b in bounds if b is not None})
    b = "__bucket"
    base = df
    for name, expr in sums.items():
        base = base.withColumn(f"__v_{name}", expr)
    if not bounds:
        # one bucket: a window per group is the whole job (no offsets to join)
        wl = Window.partitionBy(*g).orderBy(F.col(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for n in sums:
            base = base.withColumn(n, F.sum(f"__v_{n}").over(wl))
        return base.drop(*[f"__v_{n}" for n in sums])
    edges = F.array(*[F.lit(v) for v in bounds])
    base = base.withColumn(b, F.size(F.filter(edges, lambda e: e < F.col(order_col).cast("double"))))
    per_bucket = base.groupBy(*g, b).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    wo = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = per_bucket.select(*g, b, *[F.coalesce(F.sum(f"__t_{n}").over(wo), F.lit(0)).alias(f"__o_{n}") for n in sums])
    # at most (#groups x n_buckets) rows: bounded, so broadcast.
    joined = base.join(F.broadcast(offs), on=[*g, b], how="inner")
    wl = Window.partitionBy(*g, b).orderBy(F.col(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in sums:
        joined = joined.withColumn(n, F.sum(f"__v_{n}").over(wl) + F.col(f"__o_{n}"))
    return joined.drop(b, *[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def ordered_rank(df: DataFrame, col: str, out: str = "rn", n_buckets: int | None = None,
                 sample_per_bucket: int = 20, seed: int = 7) -> DataFrame:
    """Add ``out`` = row_number() over (order by ``col``) for a non-null, unique, sortable column
    (numbers or strings in code-point order) without a single-task window.

    Bucket bounds are taken from a bounded random sample of the column (about
    ``sample_per_bucket`` values per bucket); a row's bucket is a pure function of its value.
    Per-bucket counts become offsets (a small broadcast table) and rows are numbered inside
    their bucket."""
    spark = df.sparkSession
    n = df.count()
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("long"))
    if n_buckets is None:
        n_buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, n // 1000 + 1))
    frac = min(1.0, sample_per_bucket * n_buckets / n)
    sample = sorted(r[0] for r in df.select(col).sample(False, frac, seed=seed).collect() if r[0] is not None)
    bounds = []
    for i in range(1, n_buckets):
        if sample:
            v = sample[min(len(sample) - 1, int(len(sample) * i / n_buckets))]
            if not bounds or v != bounds[-1]:
                bounds.append(v)
    b = "__bucket"
    if not bounds:
        # a single bucket (small input): number the rows directly
        return df.withColumn(out, F.row_number().over(Window.orderBy(F.col(col))).cast("long"))
    arr = F.array(*[F.lit(v) for v in bounds])
    with_b = df.withColumn(b, F.size(F.filter(arr, lambda e: e < F.col(col))))
    counts = with_b.groupBy(b).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per bucket (at most n_buckets rows): a bounded table, so the window and broadcast are cheap
    offsets = counts.select(b, (F.sum("__n").over(w) - F.col("__n")).alias("__off"))
    joined = with_b.join(F.broadcast(offsets), on=b, how="inner")
    wr = Window.partitionBy(b).orderBy(F.col(col))
    return joined.withColumn(out, (F.row_number().over(wr) + F.col("__off")).cast("long")).drop(b, "__off")
