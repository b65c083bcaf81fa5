"""Rule-driven operators.

R01 turns the profile tables (E04 missing, E05 outliers, E08 health, E10 skew, E09a target)
into an ordered list of recommended steps — one query joining the per-column profiles, with
one output row per recommendation. R03 builds derive_numeric steps from a template.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.functions.columns import numeric_columns
from tabsmith.operators import profile as P

RULES = ["drop-constants", "drop-duplicates", "impute-numeric", "impute-categorical", "clip-outliers",
         "fix-skewness", "frequency-encode"]


def column_profile(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """One row per column: position, kind, missing count, constant / high-card flags, outlier
    count and skew severity (the inputs of the recommendation rules)."""
    cols = [c for c in df.columns if c != SPLIT_COL]
    pos = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, position int")
    health = P.health_columns(df.select(*cols))
    miss = P.missing_values(df.select(*cols)).select("column", F.col("count").alias("n_missing"))
    nums = [c for c in numeric_columns(df) if c != SPLIT_COL]
    out = P.outliers(df, nums, exact).select("column", "n_outliers") if nums else None
    sk = P.skew_report(df, nums).select("column", "severity") if nums else None
    j = pos.join(health.select("column", "kind", "is_constant", "is_high_card"), "column").join(miss, "column", "left")
    if out is not None:
        j = j.join(out, "column", "left").join(sk, "column", "left")
    else:
        j = j.withColumn("n_outliers", F.lit(None).cast("long")).withColumn("severity", F.lit(None).cast("string"))
    return j


def _ordered_names(cond) -> F.Column:
    """Names of the matching columns in schema order."""
    picked = F.collect_list(F.when(cond, F.struct(F.col("position"), F.col("column"))))
    return F.transform(F.array_sort(picked), lambda s: s.getField("column"))


def recommend(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """(rule_order, id, phase, step_type, columns, step) for every rule that applies."""
    prof = column_profile(df, target, exact)
    # two single numbers, resolved up front (Spark allows no subquery inside array functions)
    n_dup = P.health_summary(df.drop(SPLIT_COL) if SPLIT_COL in df.columns else df).first()["n_duplicates"]
    num = F.col("kind") == "numeric"
    const = num & F.col("is_constant")
    tgt_ok = F.lit(False)
    if target and target in numeric_columns(df):
        t = P.target_numeric(df, target, exact)
        row = t.first()
        tgt_ok = F.lit(bool(row["skewness"] is not None and abs(row["skewness"]) >= 0.5 and row["transform_hint"]))
    is_target = F.col("column") == F.lit(target) if target else F.lit(False)
    skew_cond = num & ~const & ((F.coalesce(F.col("severity"), F.lit("normal")) != "normal") | (is_target & tgt_ok))
    agg = prof.agg(
        _ordered_names(const).alias("drop-constants"),
        _ordered_names((F.col("n_missing") > 0) & num).alias("impute-numeric"),
        _ordered_names((F.col("n_missing") > 0) & ~num).alias("impute-categorical"),
        _ordered_names((F.coalesce(F.col("n_outliers"), F.lit(0)) > 0) & num).alias("clip-outliers"),
        _ordered_names(skew_cond).alias("fix-skewness"),
        _ordered_names(F.col("is_high_card")).alias("frequency-encode"),
    )
    recs = [
        ("drop-constants", "pre_split", "drop_columns", F.col("`drop-constants`"), "{}"),
        ("drop-duplicates", "pre_split", "drop_duplicates",
         F.when(F.lit(n_dup > 0), F.array().cast("array<string>")), '{"keep": "first"}'),
        ("impute-numeric", "post_split", "impute", F.col("`impute-numeric`"), '{"strategy": "median"}'),
        ("impute-categorical", "post_split", "impute", F.col("`impute-categorical`"), '{"strategy": "mode"}'),
        ("clip-outliers", "post_split", "clip_outliers", F.col("`clip-outliers`"), '{"method": "iqr"}'),
        ("fix-skewness", "post_split", "fix_skewness", F.col("`fix-skewness`"), '{"method": "auto", "threshold": 0.5}'),
        ("frequency-encode", "post_split", "frequency_encode", F.col("`frequency-encode`"), '{"normalize": true}'),
    ]
    structs = [F.struct(F.lit(i).alias("rule_order"), F.lit(rid).alias("id"), F.lit(phase).alias("phase"),
                        F.lit(kind).alias("step_type"), cols.alias("columns"), F.lit(opts).alias("options"))
               for i, (rid, phase, kind, cols, opts) in enumerate(recs)]
    rows = agg.select(F.inline(F.array(*structs)))
    keep = F.col("columns").isNotNull() & ((F.size("columns") > 0) | (F.col("id") == "drop-duplicates"))
    return rows.where(keep)


def recommendations_to_steps(recs: DataFrame, phase: str | None = None) -> list[dict]:
    """Collect the (few) recommendation rows as step dicts, optionally for one phase."""
    out = []
    r = recs.where(F.col("phase") == phase) if phase else recs
    for row in r.orderBy("rule_order").collect():
        step = {"type": row["step_type"], "columns": list(row["columns"])}
        step.update(json.loads(row["options"]))
        out.append(step)
    return out


class Template(NamedTuple):
    """Derived columns (left role, right role, operation, name) of a template. A name may hold ``{left}`` and
    ``{right}``, the chosen columns. ``whole``: all roles must be chosen, else those steps are made whose are."""

    steps: tuple[tuple[str, str, str, str], ...]
    whole: bool = True


#: The names of templates, roles and derived columns.
TEMPLATES = {
    "ratio": Template((("numerator", "denominator", "divide", "{left}_per_{right}"),)),
    "product": Template((("a", "b", "multiply", "{left}_x_{right}"),)),
    "sum_diff": Template((("a", "b", "add", "{left}_plus_{right}"), ("a", "b", "subtract", "{left}_minus_{right}"))),
    "housing_rates": Template((("total_rooms", "households", "divide", "rooms_per_household"), ("bedrooms", "total_rooms", "divide", "bedrooms_per_room")), whole=False),
    "lat_lon_interaction": Template((("lat", "lon", "multiply", "lat_times_lon"),)),
}


def derive_template(template: str, values: dict, columns: set | list | None = None) -> list[dict]:
    """The derive_numeric steps of a template for the ``values`` chosen for its roles; ``output`` names the
    column of a template with a single step and a free name. Chosen columns must be among ``columns``, if given."""
    if template not in TEMPLATES:
        raise ValueError(f"no template is called {template!r}; there are {', '.join(TEMPLATES)}")
    own = TEMPLATES[template]
    chosen = {role: str(values.get(role) or "").strip() for step in own.steps for role in step[:2]}
    missing = [role for role, c in chosen.items() if not c]
    absent = [c for c in chosen.values() if c and columns and c not in columns]
    steps = [s for s in own.steps if chosen[s[0]] and chosen[s[1]]]
    if absent:
        raise ValueError(f"{template}: no column {', '.join(absent)}")
    if not steps or (own.whole and missing):
        raise ValueError(f"{template} needs a column for {', '.join(missing)}")
    given = str(values.get("output") or "").strip() if len(own.steps) == 1 and "{" in own.steps[0][3] else ""
    return [{"type": "derive_numeric", "column_a": chosen[left], "column_b": chosen[right], "op": op,
             "output_column": given or re.sub(r"\W+", "_", name.format(left=chosen[left], right=chosen[right]), flags=re.ASCII)} for left, right, op, name in steps]
