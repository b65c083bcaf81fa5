"""Run store (S12) and model store (S13): append-only Parquet tables ``runs`` and ``importances`` plus one
saved ``PipelineModel`` folder per run, both under a shared folder (a Hadoop-FS URI on a cluster)."""

from __future__ import annotations

import hashlib
import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS_SCHEMA = ("run_id string, dataset string, model string, task string, params map<string,string>, "
               "metrics map<string,double>, tags map<string,string>, started_at timestamp, model_path string")


def _run_id(dataset: str, model: str) -> str:
    return hashlib.md5(f"{dataset}|{model}|{time.time_ns()}".encode()).hexdigest()[:16]


def log_run(spark: SparkSession, runs_dir: str, dataset: str, model: str, task: str, cfg, hyper: dict, metrics: dict,
            fitted=None, prep=None, tags: dict | None = None) -> str:
    """Append one run (params, numeric metrics, tags) and save the fitted model when it can be
    written. Returns the run id."""
    run_id = _run_id(dataset, model)
    params = {"model": model}
    if cfg is not None:
        for k in ("test_size", "scaler", "val_strategy", "cv_folds", "random_state", "imbalance_method",
                  "train_pca_components", "categorical_encoding"):
            if hasattr(cfg, k):
                params[k] = str(getattr(cfg, k))
    if prep is not None:
        params.update(n_features=str(len(prep.features)), n_train=str(prep.n_train),
                      features=json.dumps(prep.features))
    for k, v in (hyper or {}).get(model, {}).items():
        params[k] = str(v)
    mets = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    path = None
    whole = prep.pipeline(fitted) if fitted is not None and prep is not None else fitted  # takes raw rows where the preparation is known
    if whole is not None and hasattr(whole, "write"):
        path = f"{runs_dir}/models/{run_id}"
        whole.write().overwrite().save(path)
    row = [(run_id, dataset, model, task, params, mets, dict(tags or {}), datetime.now(timezone.utc).replace(tzinfo=None),
            path)]
    spark.createDataFrame(row, RUNS_SCHEMA).write.mode("append").parquet(f"{runs_dir}/runs")
    return run_id


def log_importances(spark: SparkSession, runs_dir: str, run_id: str, importances: list[tuple[str, float]]) -> None:
    """One row per feature of a run."""
    rows = [(run_id, name, float(v)) for name, v in importances]
    spark.createDataFrame(rows, "run_id string, feature string, importance double").write.mode("append").parquet(f"{runs_dir}/importances")


def read_importances(spark: SparkSession, runs_dir: str) -> DataFrame:
    return spark.read.schema("run_id string, feature string, importance double").parquet(f"{runs_dir}/importances")


def read_runs(spark: SparkSession, runs_dir: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(f"{runs_dir}/runs")


def latest_run(runs: DataFrame, dataset: str, model: str, run_id: str | None = None) -> DataFrame:
    """The run to load: by id (must match dataset and model) or the newest for dataset + model."""
    r = runs.where((F.col("dataset") == dataset) & (F.col("model") == model))
    if run_id:
        return r.where(F.col("run_id") == run_id)
    w = Window.partitionBy("dataset", "model").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return r.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def load_model(spark: SparkSession, runs_dir: str, dataset: str, model: str, run_id: str | None = None):
    """Load what a run saved, for a logged training the whole pipeline from raw rows to predictions (each
    saved stage records its own class)."""
    from pyspark.ml.util import DefaultParamsReader

    rows = latest_run(read_runs(spark, runs_dir), dataset, model, run_id).select("model_path").collect()
    if not rows or not rows[0][0]:
        raise ValueError(f"no saved model for dataset={dataset} model={model} run_id={run_id}")
    path = rows[0][0]
    meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
    module, cls = meta["class"].rsplit(".", 1)
    py_module = module.replace("org.apache.spark.ml", "pyspark.ml")
    mod = __import__(py_module, fromlist=[cls])
    return getattr(mod, cls).load(path)
