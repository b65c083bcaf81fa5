"""Registered model queries (M01, M02 with closed-form SQL oracles; flagship; training loop)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators.metrics import regression_metrics
from tabsmith.operators.models import build_estimator
from tabsmith.operators.split import holdout_split
from tabsmith.operators.training import train_all
from tabsmith.plans.fixtures import LINEITEM_KEY, table
from tabsmith.plans.flagship import flagship_plan
from tabsmith.plans.sqlgen import R, md5_key

RIDGE_ALPHA = 1.0e6


def _one_feature(s, sf, name, alpha=None):
    li = table(s, sf, "lineitem")
    lab = holdout_split(li, "l_extendedprice", 0.2, 42, stratify=False, key=LINEITEM_KEY)
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        lab.withColumn("label", F.col("l_extendedprice")))
    train = data.where(F.col(SPLIT_COL) == "train")
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    hyper = {"ridge": {"alpha": alpha}} if alpha is not None else {}
    model = build_estimator(name, "regression", hyper, n=n, y_std=sd).fit(train)
    return regression_metrics(model.transform(data), "label", "prediction", by=SPLIT_COL)


def _train_all_linear(s, sf):
    li = table(s, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    return train_all(li, "l_extendedprice", "regression", {"ridge": {"alpha": 10.0}},
                     ["linear_regression", "ridge"], {"val_strategy": "kfold", "cv_folds": 3})


QUERIES = {
    "m01_linear_regression": lambda s, sf: _one_feature(s, sf, "linear_regression"),
    "m02_ridge": lambda s, sf: _one_feature(s, sf, "ridge", RIDGE_ALPHA),
    "flagship_ridge_metrics": lambda s, sf: flagship_plan(s, sf),
    "d07_train_all_linear": _train_all_linear,
}


def _one_feature_sql(alpha: float | None) -> str:
    slope = "regr_slope(y, x)" if alpha is None else f"regr_sxy(y, x) / (regr_sxx(y, x) + {alpha})"
    e = "(y - (c.b0 + c.b1 * x))"
    return f"""WITH lab AS (SELECT l_extendedprice AS y, l_quantity AS x,
  CASE WHEN row_number() OVER (ORDER BY {md5_key(LINEITEM_KEY, 42)}) <= (SELECT ceil(count(*) * 0.2) FROM lineitem)
       THEN 'test' ELSE 'train' END AS {SPLIT_COL} FROM lineitem),
c0 AS (SELECT {slope} AS b1, avg(y) AS my, avg(x) AS mx FROM lab WHERE {SPLIT_COL} = 'train'),
c AS (SELECT b1, my - b1 * mx AS b0 FROM c0)
SELECT {SPLIT_COL}, CAST(count(*) AS BIGINT) AS n, {R(f'sqrt(avg({e} * {e}))')} AS rmse, {R(f'avg(abs({e}))')} AS mae,
  {R(f'1 - sum({e} * {e}) / (var_pop(y) * count(y))')} AS r2
FROM lab, c GROUP BY {SPLIT_COL}"""


ORACLE = {
    "m01_linear_regression": _one_feature_sql(None),
    "m02_ridge": _one_feature_sql(RIDGE_ALPHA),
}
