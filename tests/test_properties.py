"""Closed-form and invariant checks for operators without a SQL oracle."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.functions.columns import row_hash
from tabsmith.functions.ranking import hash_rank, ordered_cumsum, ordered_rank
from tabsmith.operators import split as S
from tabsmith.operators.models import build_estimator
from tabsmith.operators.steps import apply_steps, power_lambda
from tests.conftest import SF_SMALL

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@pytest.fixture(scope="module")
def li(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")


def test_ridge_matches_closed_form(li):
    cols = ["l_quantity", "l_discount", "l_tax"]
    pdf = li.select(*cols, "l_extendedprice").toPandas()
    X, y = pdf[cols].values, pdf["l_extendedprice"].values
    df = VectorAssembler(inputCols=cols, outputCol="features").transform(li.withColumn("label", F.col("l_extendedprice")))
    for alpha in (1.0, 500.0):
        m = build_estimator("ridge", "regression", {"ridge": {"alpha": alpha}}, n=len(y), y_std=float(np.std(y))).fit(df)
        Xc, yc = X - X.mean(0), y - y.mean()
        w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
        assert np.allclose(m.coefficients.toArray(), w, rtol=1e-6, atol=1e-6)
        assert math.isclose(m.intercept, y.mean() - X.mean(0) @ w, rel_tol=1e-8)


def test_pca_scores_match_svd(li):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = apply_steps(li, [{"type": "pca_projection", "columns": cols, "n_components": 2}])
    pdf = out.select(*KEY, *cols, "PC_1", "PC_2").toPandas()
    X = pdf[cols].values
    Xc = X - X.mean(0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    for j in range(2):
        v = vt[j] * np.sign(vt[j][np.argmax(np.abs(vt[j]))])
        assert np.allclose(pdf[f"PC_{j + 1}"].values, Xc @ v, rtol=1e-6, atol=1e-6)
    # scores are centred and uncorrelated
    assert abs(pdf["PC_1"].mean()) < 1e-6 and abs(np.corrcoef(pdf["PC_1"], pdf["PC_2"])[0, 1]) < 1e-6


def _yj(x, lam):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def _yj_ll(x, lam):
    y = _yj(x, lam)
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))


def test_yeo_johnson_lambda_is_a_likelihood_maximum(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("v", F.col("value") - 50)
    lam, mean, sd = power_lambda(ev, "v", "yeo_johnson")
    x = ev.select("v").toPandas()["v"].values
    ll = _yj_ll(x, lam)
    for eps in (0.01, 0.05):
        assert ll >= _yj_ll(x, lam - eps) - 1e-6 and ll >= _yj_ll(x, lam + eps) - 1e-6
    y = _yj(x, lam)
    assert math.isclose(mean, y.mean(), rel_tol=1e-6) and math.isclose(sd, y.std(), rel_tol=1e-6)


def test_box_cox_step_standardises(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = apply_steps(ev, [{"type": "fix_skewness", "columns": ["value"], "method": "box_cox"}])
    r = out.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.skewness("value").alias("g")).first()
    assert abs(r["m"]) < 1e-6 and abs(r["s"] - 1) < 1e-6 and abs(r["g"]) < 0.5


def test_kfold_sizes_and_disjointness(li):
    f = S.kfold(li, 5, 42, KEY).groupBy("fold").count().collect()
    sizes = sorted(r["count"] for r in f)
    assert sum(sizes) == li.count() and max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def test_stratified_kfold_per_class_balance(li):
    f = S.stratified_kfold(li, "l_returnflag", 4, 42, KEY).groupBy("l_returnflag", "fold").count().collect()
    by_cls = {}
    for r in f:
        by_cls.setdefault(r["l_returnflag"], []).append(r["count"])
    for counts in by_cls.values():
        assert len(counts) == 4 and max(counts) - min(counts) <= 1


def test_assignments_do_not_depend_on_partitioning(li):
    a = S.holdout_split(li.repartition(3), "l_returnflag", 0.2, 7, key=KEY).select(*KEY, SPLIT_COL)
    b = S.holdout_split(li.repartition(11), "l_returnflag", 0.2, 7, key=KEY).select(*KEY, SPLIT_COL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hash_rank_equals_row_number(li):
    keyed = li.withColumn("h", row_hash(KEY, 3))
    a = hash_rank(keyed, "h", groups=["l_returnflag"], out="rn").select(*KEY, "rn")
    w = Window.partitionBy("l_returnflag").orderBy("h")
    b = keyed.withColumn("rn", F.row_number().over(w).cast("long")).select(*KEY, "rn")
    assert a.exceptAll(b).count() == 0


def test_ordered_rank_and_cumsum_equal_plain_windows(li):
    d = li.select(F.concat_ws("-", *KEY).alias("k"), "l_quantity").dropDuplicates(["k"])
    a = ordered_rank(d, "k", "rn", n_buckets=7).select("k", "rn")
    b = d.withColumn("rn", F.row_number().over(Window.orderBy("k")).cast("long")).select("k", "rn")
    assert a.exceptAll(b).count() == 0
    s = li.groupBy("l_extendedprice").agg(F.sum("l_quantity").alias("q"))
    c = ordered_cumsum(s, "l_extendedprice", {"cq": F.col("q")}, n_buckets=5).select("l_extendedprice", "cq")
    w = Window.orderBy("l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = s.withColumn("cq", F.sum("q").over(w)).select("l_extendedprice", "cq")
    assert c.exceptAll(e).count() == 0


def test_holdout_sizes_and_stratification(li):
    n = li.count()
    out = S.holdout_split(li, "l_returnflag", 0.25, 42, key=KEY)
    counts = {r[SPLIT_COL]: r["count"] for r in out.groupBy(SPLIT_COL).count().collect()}
    assert counts["test"] == math.ceil(n * 0.25) and counts["train"] == n - counts["test"]
    per = out.groupBy("l_returnflag", SPLIT_COL).count().collect()
    for cls in {r["l_returnflag"] for r in per}:
        c = {r[SPLIT_COL]: r["count"] for r in per if r["l_returnflag"] == cls}
        assert abs(c["test"] / (c["test"] + c["train"]) - 0.25) < 0.01


def test_unshuffled_stratified_is_an_error(li):
    with pytest.raises(ValueError):
        S.holdout_split(li, "l_returnflag", 0.2, shuffle=False, stratify=True)


def test_distributed_quantiles_equal_exact_percentile(spark):
    from tabsmith.functions.stats import distributed_quantiles

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    cols = ["value", "user_id", "event_id"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = distributed_quantiles(ev, cols, probs)
    want = ev.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(c)
                    for c in cols]).first()
    for c in cols:
        assert np.allclose(got[c], want[c], rtol=1e-12, atol=1e-9), (c, got[c], want[c])
