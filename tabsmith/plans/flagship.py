"""Flagship plan: hold-out split -> ship-date parts -> frequency encoding -> IQR clip ->
standard scaling (fitted on training rows) -> ridge on l_extendedprice -> metrics by split."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from tabsmith import SPLIT_COL
from tabsmith.operators.metrics import regression_metrics
from tabsmith.operators.models import build_estimator
from tabsmith.operators.steps import apply_steps
from tabsmith.operators.training import SplitConfig, prepare
from tabsmith.plans.fixtures import LINEITEM_KEY, table

TARGET = "l_extendedprice"

FLAGSHIP_STEPS = [
    {"type": "train_test_split", "target_column": TARGET, "test_size": 0.2, "random_state": 42, "key": LINEITEM_KEY},
    {"type": "extract_datetime", "columns": ["l_shipdate"], "parts": ["year", "month", "dow"]},
    {"type": "frequency_encode", "columns": ["l_returnflag"]},
    {"type": "clip_outliers", "columns": ["l_quantity"], "method": "iqr"},
    {"type": "drop_columns", "columns": ["l_shipdate", "l_returnflag", "l_linestatus", "l_orderkey", "l_partkey",
                                         "l_suppkey"]},
]


def flagship_plan(spark: SparkSession, sf_dir: str, alpha: float = 1.0) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    df = apply_steps(li, FLAGSHIP_STEPS, fit_scope="train")
    prep = prepare(df, TARGET, SplitConfig(scaler="standard", val_strategy="none"), task="regression")
    data = VectorAssembler(inputCols=prep.features, outputCol="features").transform(prep.frame)
    est = build_estimator("ridge", "regression", {"ridge": {"alpha": alpha}}, n=prep.n_train, y_std=prep.y_std)
    model = est.fit(data.where(data[SPLIT_COL] == "train"))
    return regression_metrics(model.transform(data), "label", "prediction", by=SPLIT_COL)
