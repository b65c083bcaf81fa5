"""Registered streaming query: the T22 pipeline fitted on the static table and applied to a
file stream of the same table (availableNow trigger, foreachBatch sink into the shared scratch
folder); the written batches are read back. Its oracle is the batch pipeline's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsmith.operators.training import train_all
from tabsmith.plans.fixtures import orders_nulls, table
from tabsmith.plans.step_queries import ORACLE as STEP_ORACLE
from tabsmith.plans.step_queries import PIPE_STEPS
from tabsmith.session import ensure_checkpoint_dir
from tabsmith.streaming.apply_stream import apply_fitted_stream, write_batches


def _with_nulls(df):
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def pipeline_on_stream(s, sf):
    static = orders_nulls(s, sf)
    schema = table(s, sf, "orders").schema
    stream = _with_nulls(s.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf))
    out = apply_fitted_stream(stream, PIPE_STEPS, fit_on=static)
    root = f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex[:8]}"
    q = write_batches(out, f"{root}/out", f"{root}/ckpt", trigger_once=True)
    q.awaitTermination()
    res = s.read.parquet(f"{root}/out").drop("batch")
    return res.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderstatus_O",
                      "o_orderstatus_P", "o_orderpriority", F.round("o_orderpriority_freq", 6).alias("o_orderpriority_freq"))


def train_all_classification(s, sf):
    lab = table(s, sf, "labels")
    docs = table(s, sf, "documents").select("doc_id", "n_chars")
    df = lab.join(docs, "doc_id").select("n_chars", "toxic", "quality")
    hyper = {"random_forest": {"n_estimators": 20, "max_depth": 6}, "gradient_boosting": {"n_estimators": 20},
             "logistic_regression": {"max_iter": 100}}
    return train_all(df, "quality", "classification", hyper,
                     ["logistic_regression", "ridge_classifier", "decision_tree", "random_forest", "gradient_boosting"],
                     {"val_strategy": "none"})


QUERIES = {
    "t22_apply_pipeline_stream": pipeline_on_stream,
    "d07_train_all_classification": train_all_classification,
}

ORACLE = {"t22_apply_pipeline_stream": STEP_ORACLE["t22_apply_pipeline"]}
