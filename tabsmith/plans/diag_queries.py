"""Registered diagnostics / tuning / scoring / version queries (C12, D16–D18, H02, H03, X07,
X10, X11, T23, T24, S02–S04, S07, S08). Model fits have no SQL oracle (rows-only checks)
except C12 with one feature, whose leverage has a closed form."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators import runs as X
from tabsmith.operators.diagnostics import learning_curve, loo_press, permutation_importance, scaler_baseline
from tabsmith.operators.models import build_estimator
from tabsmith.operators.search import refit_best, tune
from tabsmith.operators.split import holdout_split
from tabsmith.operators.steps import preview_steps
from tabsmith.plans.fixtures import LINEITEM_KEY, ORDERS_NULLS_SQL, orders_nulls, table
from tabsmith.plans.sqlgen import R
from tabsmith.operators.training import train_all
from tabsmith.session import ensure_checkpoint_dir
from tabsmith.sources import io as IO
from tabsmith.sources.runs import load_model

FEATS = ["l_quantity", "l_discount", "l_tax"]


def _scratch(s, name):
    return f"{ensure_checkpoint_dir(s)}/{name}-{uuid.uuid4().hex[:8]}"


def _assembled(s, sf):
    li = holdout_split(table(s, sf, "lineitem"), "l_extendedprice", 0.2, 42, stratify=False, key=LINEITEM_KEY)
    va = VectorAssembler(inputCols=FEATS, outputCol="features")
    return va.transform(li.withColumn("label", F.col("l_extendedprice")))


def _d16(s, sf):
    d = _assembled(s, sf)
    return scaler_baseline(d.where(F.col(SPLIT_COL) == "train"), d.where(F.col(SPLIT_COL) == "test"), FEATS, "label")


def _d17(s, sf):
    d = _assembled(s, sf).where(F.col(SPLIT_COL) == "train").select("features", "label", *LINEITEM_KEY)
    return learning_curve(d, "ridge", "regression", key=LINEITEM_KEY)


def _d18(s, sf):
    d = _assembled(s, sf)
    m = build_estimator("linear_regression", "regression").fit(d.where(F.col(SPLIT_COL) == "train"))
    return permutation_importance(m, d.where(F.col(SPLIT_COL) == "test"), FEATS, "regression", repeats=4,
                                  key=LINEITEM_KEY)


def _labelled(s, sf, *features):
    """The features, target and hold-out labels of lineitem."""
    li = holdout_split(table(s, sf, "lineitem"), "l_extendedprice", 0.2, 42, stratify=False, key=LINEITEM_KEY)
    return li.select(*features, "l_extendedprice", SPLIT_COL)


def _one_feature(s, li, feature):
    """A pipeline of scaler and least squares on one feature, fitted on the training rows, saved as a run and
    loaded again."""
    runs = _scratch(s, "runs")
    train_all(li.select(feature, "l_extendedprice", SPLIT_COL), "l_extendedprice", "regression", models=["linear_regression"],
              split_config={"val_strategy": "none"}, runs_dir=runs, dataset="lineitem")
    return load_model(s, runs, "lineitem", "linear_regression")


def _x10_saved(s, sf):
    return X.score(_one_feature(s, _labelled(s, sf, "l_quantity"), "l_quantity"), table(s, sf, "lineitem")).select(*LINEITEM_KEY, F.round("prediction", 3).alias("prediction"))


def _x11_saved(s, sf):
    li = _labelled(s, sf, "l_quantity", "l_tax").persist(StorageLevel.MEMORY_AND_DISK)  # labelled once for both
    models = {c: _one_feature(s, li, c) for c in ("l_quantity", "l_tax")}
    li.unpersist()
    out = X.score_all(models, table(s, sf, "lineitem"), LINEITEM_KEY)
    return out.select(*LINEITEM_KEY, *(F.round(c, 3).alias(c) for c in ("min_pred", "max_pred", "spread")))


def _x07(s, sf):
    d = _assembled(s, sf).where(F.col(SPLIT_COL) == "train")
    m = build_estimator("ridge", "regression", {"ridge": {"alpha": 10.0}}, n=d.count(), y_std=1.0).fit(d)
    return s.createDataFrame(X.feature_importance(m, FEATS), "feature string, importance double")


def _x10(s, sf):
    """Fitted on the labelled documents, scoring all."""
    docs = VectorAssembler(inputCols=["n_chars"], outputCol="features").transform(table(s, sf, "documents").select("doc_id", "n_chars"))
    known = docs.join(table(s, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    m = build_estimator("logistic_regression", "classification", n=known.count()).fit(known)
    return X.score(m, docs).select("doc_id", "prediction", "confidence")


def _x11(s, sf):
    d = _assembled(s, sf)
    train = d.where(F.col(SPLIT_COL) == "train")
    models = {"ols": build_estimator("linear_regression", "regression").fit(train),
              "tree": build_estimator("decision_tree", "regression", {"decision_tree": {"max_depth": 4}}).fit(train)}
    return X.score_all(models, d.where(F.col(SPLIT_COL) == "test"), LINEITEM_KEY)


def _h02(s, sf):
    li = table(s, sf, "lineitem").select(*FEATS, "l_extendedprice")
    return tune(li, "l_extendedprice", "ridge", n_trials=4, task="regression", split_config={"cv_folds": 3},
                parallelism=4)


def _h03(s, sf):
    li = table(s, sf, "lineitem").select(*FEATS, "l_extendedprice")
    trials = tune(li, "l_extendedprice", "ridge", n_trials=3, task="regression", split_config={"cv_folds": 2},
                  parallelism=3)
    r = refit_best(li, "l_extendedprice", "ridge", trials, "regression")
    return s.createDataFrame([(r["best_trial"], float(r["params"]["alpha"]), r["rmse"], r["train_rmse"])],
                             "best_trial int, alpha double, rmse double, train_rmse double")


def _t24(s, sf):
    """Apply -> version -> history -> reset round trip under a scratch root; returns the
    written version (read back from Parquet)."""
    root = _scratch(s, "versions")
    src = _scratch(s, "orders-src")
    IO.write_version(orders_nulls(s, sf), src)
    IO.save_holdout(s, root, "orders", src, {"target": "o_orderpriority", "test_size": 0.2, "key": ["o_orderkey"]})
    IO.apply_and_save(s, root, "orders", src, [{"type": "impute", "columns": ["o_totalprice"], "strategy": "zero"}])
    out = IO.apply_and_save(s, root, "orders", src, [{"type": "drop_columns", "columns": ["o_custkey"]}])
    assert [st["type"] for st in IO.history(s, root, "orders")] == ["impute", "drop_columns"]
    status = IO.holdout_status(s, root, "orders")
    assert status["configured"] and status["column_present"] and status["n_test"] > 0
    return s.read.parquet(out["path"])


def _s02(s, sf):
    path = _scratch(s, "orders-json")
    table(s, sf, "orders").write.mode("overwrite").json(path)
    return IO.read_table(s, path, "json").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _s04(s, sf):
    cat = _scratch(s, "catalog")
    for name in ("orders", "customer", "part"):
        df = table(s, sf, name)
        IO.upsert_dataset(s, cat, IO.dataset_meta(df, name, f"{name}.parquet", f"{sf}/{name}.parquet"))
    return IO.list_datasets(s, cat).select("id", "n_rows", "n_cols")


QUERIES = {
    "c12_loo_press": lambda s, sf: loo_press(table(s, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    .select(F.col("n").cast("long").alias("n"), F.round("loo_rmse", 4).alias("loo_rmse")),
    "d16_scaler_baseline": _d16,
    "d17_learning_curve": _d17,
    "d18_permutation_importance": _d18,
    "h02_tune_trials": _h02,
    "h03_refit_best": _h03,
    "x07_feature_importance": _x07,
    "x10_score": _x10,
    "x10_score_saved": _x10_saved,
    "x11_score_all_saved": _x11_saved,
    "x11_score_all": _x11,
    "t23_preview_after": lambda s, sf: preview_steps(orders_nulls(s, sf), [
        {"type": "impute", "columns": ["o_totalprice"], "strategy": "zero"}], 5, ["o_orderkey"])[1],
    "t24_apply_versions": _t24,
    "s02_read_table_json": _s02,
    "s04_list_datasets": _s04,
    "f06_split_rows": lambda s, sf: _f06(s, sf),
}


def _f06(s, sf):
    """train / test rows of a labelled frame (validated), counted per label."""
    from tabsmith.operators.split import split_rows

    lab = holdout_split(table(s, sf, "orders"), "o_totalprice", 0.2, 42, stratify=False, key=["o_orderkey"])
    tr, te = split_rows(lab)
    return tr.groupBy(SPLIT_COL).count().unionByName(te.groupBy(SPLIT_COL).count()) \
        .select(SPLIT_COL, F.col("count").cast("long").alias("n"))

def _fit_sql(*features):
    split = ", ".join(f"CAST({c} AS VARCHAR)" for c in LINEITEM_KEY)
    fits = ", ".join(f"regr_slope(l_extendedprice, {c}) AS b_{c}, regr_intercept(l_extendedprice, {c}) AS a_{c}" for c in features)
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('~', {split}, '42'))) AS rn FROM lineitem),
f AS (SELECT {fits} FROM r WHERE rn > (SELECT ceil(count(*) * 0.2) FROM lineitem)),
p AS (SELECT {', '.join(LINEITEM_KEY)}, {', '.join(f'a_{c} + b_{c} * {c} AS p_{c}' for c in features)} FROM lineitem, f)"""


ORACLE = {
    "x10_score_saved": _fit_sql("l_quantity") + f"SELECT {', '.join(LINEITEM_KEY)}, {R('p_l_quantity', 3)} AS prediction FROM p",
    "x11_score_all_saved": _fit_sql("l_quantity", "l_tax") + f"""SELECT {', '.join(LINEITEM_KEY)}, {R('min(least(p_l_quantity, p_l_tax))', 3)} AS min_pred,
  {R('max(greatest(p_l_quantity, p_l_tax))', 3)} AS max_pred, {R('max(greatest(p_l_quantity, p_l_tax)) - min(least(p_l_quantity, p_l_tax))', 3)} AS spread
FROM p GROUP BY {', '.join(LINEITEM_KEY)}""",
    "c12_loo_press": f"""WITH s AS (SELECT count(*) AS n, avg(CAST(l_quantity AS DOUBLE)) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx,
    regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0 FROM lineitem),
e AS (SELECT (l_extendedprice - (b0 + b1 * l_quantity)) / (1 - (1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx)) AS e
      FROM lineitem, s)
SELECT CAST(count(*) AS BIGINT) AS n, {R('sqrt(avg(e * e))')} AS loo_rmse FROM e""",
    "t23_preview_after": "WITH " + ORDERS_NULLS_SQL + """
SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, 0.0) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders_nulls ORDER BY md5(concat_ws('~', CAST(o_orderkey AS VARCHAR), '0')) LIMIT 5""",
    "s02_read_table_json": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "f06_split_rows": f"""SELECT {SPLIT_COL}, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('~', CAST(o_orderkey AS VARCHAR), '42')))
    <= (SELECT ceil(count(*) * 0.2) FROM orders) THEN 'test' ELSE 'train' END AS {SPLIT_COL} FROM orders)
GROUP BY {SPLIT_COL}""",
    "s04_list_datasets": """SELECT 'orders' AS id, CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_cols FROM orders
UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT), CAST(5 AS BIGINT) FROM customer
UNION ALL SELECT 'part', CAST(count(*) AS BIGINT), CAST(6 AS BIGINT) FROM part""",
}
