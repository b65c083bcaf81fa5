"""Streaming application of fitted steps, diagnostics, tuning, run store."""

import math
import tempfile

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators.diagnostics import learning_curve, loo_press, permutation_importance, scaler_baseline
from tabsmith.operators.models import build_estimator
from tabsmith.operators.search import draw, refit_best, tune
from tabsmith.operators.steps import apply_steps
from tabsmith.operators.training import train_all
from tabsmith.sources.runs import load_model, read_runs
from tabsmith.streaming.apply_stream import apply_fitted_stream, write_batches
from tests.conftest import SF_SMALL

STEPS = [
    {"type": "impute", "columns": ["o_totalprice"], "strategy": "median"},
    {"type": "clip_outliers", "columns": ["o_totalprice"], "method": "iqr"},
    {"type": "scale", "columns": ["o_totalprice"], "method": "standard"},
    {"type": "frequency_encode", "columns": ["o_orderpriority"]},
    {"type": "extract_datetime", "columns": ["o_orderdate"], "parts": ["year", "dow"]},
]


def test_fitted_steps_on_a_stream_equal_batch(spark):
    src = f"{SF_SMALL}/orders.parquet"
    static = spark.read.parquet(src)
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "orders.parquet").parquet(SF_SMALL)
    out = apply_fitted_stream(stream, STEPS, fit_on=static)
    d = tempfile.mkdtemp(prefix="tabsmith-stream-")
    q = write_batches(out, f"{d}/out", f"{d}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{d}/out").drop("batch")
    want = apply_steps(static, STEPS)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == want.count()


def test_loo_press_matches_numpy(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    feats = ["l_quantity", "l_discount"]
    r = loo_press(li, feats, "l_extendedprice", alpha=0.0).first()
    pdf = li.select(*feats, "l_extendedprice").toPandas()
    X = np.c_[np.ones(len(pdf)), pdf[feats].values]
    y = pdf["l_extendedprice"].values
    H = X @ np.linalg.pinv(X.T @ X) @ X.T
    e = y - H @ y
    press = float(np.sum((e / (1 - np.diag(H))) ** 2))
    assert math.isclose(r["press"], press, rel_tol=1e-6)


def _assembled(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_tax"]
    va = VectorAssembler(inputCols=feats, outputCol="features")
    d = va.transform(li.withColumn("label", F.col("l_extendedprice")))
    return d, feats


def test_diagnostics_run(spark):
    d, feats = _assembled(spark)
    lc = learning_curve(d.select("features", "label", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
                        "ridge", "regression", key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    sizes = [r["train_size"] for r in lc.orderBy("fraction").collect()]
    assert sizes == sorted(sizes) and len(sizes) == 4
    m = build_estimator("linear_regression", "regression").fit(d)
    pi = permutation_importance(m, d, feats, "regression", repeats=2)
    rows = {r["feature"]: r["mean"] for r in pi.collect()}
    assert set(rows) == set(feats)
    sb = scaler_baseline(d.limit(4000), d.exceptAll(d.limit(4000)), feats, "label").collect()
    rmses = [r["rmse"] for r in sb]
    assert max(rmses) - min(rmses) < 1e-3 and sum(r["is_best"] for r in sb) == 1


def test_train_all_tune_and_run_store(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax",
                                                                     "l_extendedprice")
    runs = tempfile.mkdtemp(prefix="tabsmith-runs-")
    board = train_all(li, "l_extendedprice", "regression", None, ["linear_regression", "ridge", "decision_tree"],
                      {"val_strategy": "kfold", "cv_folds": 3}, runs_dir=runs, dataset="li")
    rows = board.collect()
    assert [r["model"] for r in rows][0] in {"linear_regression", "ridge", "decision_tree"}
    assert all(r["cv_folds_run"] == 3 for r in rows)
    assert read_runs(spark, runs).count() == 3
    m = load_model(spark, runs, "li", "ridge")
    assert hasattr(m.stages[-1], "coefficients") and "prediction" in m.transform(li).columns
    assert draw("ridge", 3) == draw("ridge", 3) and 0.001 <= draw("ridge", 3)["alpha"] <= 100
    trials = tune(li, "l_extendedprice", "ridge", n_trials=3, task="regression",
                  split_config={"cv_folds": 2}, parallelism=2)
    assert trials.where("state = 'COMPLETE'").count() == 3
    best = refit_best(li, "l_extendedprice", "ridge", trials, "regression", runs_dir=runs, dataset="li")
    assert best["rmse"] > 0 and read_runs(spark, runs).count() == 4


def test_classification_train_all(spark):
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "n_chars")
    df = lab.join(docs, "doc_id").select("n_chars", "toxic", "quality")
    board = train_all(df, "quality", "classification", None, ["logistic_regression", "ridge_classifier",
                                                               "gradient_boosting"],
                      {"val_strategy": "kfold", "cv_folds": 2}).collect()
    assert len(board) == 3 and all(0 <= r["accuracy"] <= 1 for r in board)
    assert SPLIT_COL


def test_training_with_pca_and_undersampling(spark):
    from tabsmith.operators.training import SplitConfig, assemble, fit_and_score, prepare

    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax",
                                                                     "l_extendedprice", "l_returnflag")
    cfg = SplitConfig(val_strategy="none", train_pca_components=2, imbalance_method="random_under")
    prep = prepare(li, "l_returnflag", cfg, "classification")
    assert prep.features == ["pca_0", "pca_1"] and prep.classes == ["A", "N", "R"]
    res = fit_and_score("logistic_regression", prep, assemble(prep, cfg), None, cfg)
    assert 0 <= res["accuracy"] <= 1 and len(res["importances"]) == 2


def test_cv_scaler_refit_per_fold_equals_raw_refit(spark):
    """Refitting the scaler on each fold's (already scaled) training rows gives the same CV
    metrics as scaling the raw fold rows directly."""
    from tabsmith.operators.training import SplitConfig, assemble, cross_validate, prepare

    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").alias("rid"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    key = ["rid"]
    for scaler in ("standard", "minmax"):
        cfg = SplitConfig(val_strategy="kfold", cv_folds=3, scaler=scaler, key=key)
        prep = prepare(li, "l_extendedprice", cfg, "regression")
        data = assemble(prep, cfg)
        train = data.where(F.col(SPLIT_COL) == "train")
        a = cross_validate("ridge", prep, train, {"ridge": {"alpha": 50.0}}, cfg)
        cfg_raw = SplitConfig(val_strategy="kfold", cv_folds=3, scaler="none", key=key)
        prep_raw = prepare(li, "l_extendedprice", cfg_raw, "regression")
        # same folds, raw features, scaler refitted per fold inside cross_validate
        prep_raw.scaled = list(prep_raw.features)
        cfg_raw.scaler = scaler
        raw_train = assemble(prep_raw, SplitConfig(val_strategy="kfold", cv_folds=3, key=key)) \
            .where(F.col(SPLIT_COL) == "train")
        b = cross_validate("ridge", prep_raw, raw_train, {"ridge": {"alpha": 50.0}}, cfg_raw)
        assert abs(a["cv_rmse"] - b["cv_rmse"]) < 1e-3, (scaler, a, b)
