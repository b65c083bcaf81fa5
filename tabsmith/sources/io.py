"""Scans, sinks and dataset versions.

Datasets and their versions live as Parquet directories under a shared root (any Hadoop-FS
URI). The catalog (S03/S04) and the version log (S08) are small append-only Parquet tables;
a lookup takes the newest row per key with ``row_number()``.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith import SPLIT_COL
from tabsmith.functions.columns import nan_to_null

# The strings pandas.read_csv treats as missing by default (pandas IO docs,
# "na_values"), so a CSV loads with the same nulls.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: Text that pandas reads as a number; a cast alone would also take Java's suffixes (12d, 7f).
NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"


def detect_separator(spark: SparkSession, path: str) -> str:
    """``sep="auto"``: the more frequent of ',' and ';' in the header line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_csv(spark: SparkSession, path: str, sep: str = ",", null_tokens=NULL_TOKENS, infer: bool = True,
             schema: str | None = None) -> DataFrame:
    """Header CSV; null tokens become NULL; column types inferred like pandas (integers ->
    bigint, other numbers -> double, True/False -> boolean, else string) from ONE aggregate
    over the whole file. An empty table is an error."""
    if sep == "auto":
        sep = detect_separator(spark, path)
    if schema:
        return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    tokens = F.array(*[F.lit(t) for t in null_tokens])
    cols = raw.columns
    nulled = raw.select(*[F.when(F.array_contains(tokens, F.col(f"`{c}`")) | F.col(f"`{c}`").isNull(), F.lit(None))
                         .otherwise(F.col(f"`{c}`")).alias(c) for c in cols])
    if not cols:
        raise ValueError("empty CSV")
    if not infer:
        return nulled
    probes = []
    for c in cols:
        s = F.trim(F.col(f"`{c}`"))
        probes += [F.count(s).alias(f"n_{c}"),
                   F.count(s.try_cast("long")).alias(f"l_{c}"),
                   F.count(F.when(s.rlike(NUMBER), s.try_cast("double"))).alias(f"d_{c}"),
                   F.count_if(s.isin("True", "False", "true", "false")).alias(f"b_{c}")]
    stats = nulled.agg(F.count(F.lit(1)).alias("__rows"), *probes).first()
    if stats["__rows"] == 0:
        raise ValueError("No columns to parse from file: the table is empty")
    out = []
    for c in cols:
        n = stats[f"n_{c}"]
        s = F.trim(F.col(f"`{c}`"))
        if n > 0 and stats[f"l_{c}"] == n:
            out.append(s.try_cast("long").alias(c))
        elif n > 0 and stats[f"d_{c}"] == n:
            out.append(s.try_cast("double").alias(c))
        elif n > 0 and stats[f"b_{c}"] == n:
            out.append((F.lower(s) == "true").alias(c))
        elif n == 0:
            out.append(F.lit(None).cast("double").alias(c))
        else:
            out.append(F.col(f"`{c}`").alias(c))
    return nulled.select(*out)


def read_table(spark: SparkSession, uri: str, fmt: str | None = None, **opts) -> DataFrame:
    """Any Hadoop-FS URI (file:, hdfs:, s3a:, ...) in csv / parquet / json / orc; NaN is read as
    missing."""
    if fmt is None:
        ext = uri.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)
        fmt = ext[1].lower() if len(ext) == 2 and ext[1].lower() in ("csv", "json", "parquet", "orc") else "parquet"
    if fmt == "csv":
        return read_csv(spark, uri, **opts)
    return nan_to_null(spark.read.format(fmt).options(**opts).load(uri))


def dataset_meta(df: DataFrame, dataset_id: str, filename: str, storage_path: str) -> dict:
    """Columns, dtypes and shape of a dataset (one count)."""
    return {"id": dataset_id, "filename": filename, "storage_path": storage_path,
            "columns": json.dumps(df.columns), "dtypes": json.dumps(dict(df.dtypes)),
            "n_rows": df.count(), "n_cols": len(df.columns),
            "created_at": datetime.now(timezone.utc).replace(tzinfo=None)}


CATALOG_SCHEMA = ("id string, filename string, storage_path string, columns string, dtypes string, n_rows long, "
                  "n_cols long, created_at timestamp")


def upsert_dataset(spark: SparkSession, catalog_dir: str, meta: dict) -> None:
    """Append the new metadata row; ``get_dataset`` reads the newest row per id."""
    row = [tuple(meta[k] for k in ("id", "filename", "storage_path", "columns", "dtypes", "n_rows", "n_cols",
                                   "created_at"))]
    spark.createDataFrame(row, CATALOG_SCHEMA).write.mode("append").parquet(f"{catalog_dir}/datasets")


def _catalog(spark: SparkSession, catalog_dir: str) -> DataFrame:
    d = spark.read.schema(CATALOG_SCHEMA).parquet(f"{catalog_dir}/datasets")
    w = Window.partitionBy("id").orderBy(F.col("created_at").desc())
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def get_dataset(spark: SparkSession, catalog_dir: str, dataset_id: str) -> dict:
    rows = _catalog(spark, catalog_dir).where(F.col("id") == dataset_id).collect()
    if not rows:
        raise KeyError(f"Dataset not found: {dataset_id}")
    return rows[0].asDict()


def list_datasets(spark: SparkSession, catalog_dir: str) -> DataFrame:
    """Newest first."""
    return _catalog(spark, catalog_dir).orderBy(F.col("created_at").desc(), F.col("id"))


def preview(df: DataFrame, limit: int = 10, order_by: list | None = None):
    """First ``limit`` rows (by ``order_by``) and a column summary (dtype, nulls, shape)."""
    rows = (df.orderBy(*order_by) if order_by else df).limit(limit)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType,))}
    structs = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.lit(c in numeric).alias("is_numeric"),
                        F.count_if(F.col(f"`{c}`").isNull()).cast("long").alias("n_null")) for c, t in df.dtypes]
    summary = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*structs).alias("s")).select(
        F.inline("s"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))
    return rows, summary


def write_version(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a version (Parquet; CSV with a header for export)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        w.parquet(path)
    return path


VERSIONS_SCHEMA = "dataset string, version string, path string, steps string, holdout string, applied_at timestamp"


def record_version(spark: SparkSession, root: str, dataset: str, path: str, steps: list, holdout: dict | None) -> str:
    version = uuid.uuid4().hex[:12]
    row = [(dataset, version, path, json.dumps(steps), json.dumps(holdout) if holdout else None,
            datetime.now(timezone.utc).replace(tzinfo=None))]
    spark.createDataFrame(row, VERSIONS_SCHEMA).write.mode("append").parquet(f"{root}/versions")
    return version


def latest_version(spark: SparkSession, root: str, dataset: str):
    try:
        v = spark.read.schema(VERSIONS_SCHEMA).parquet(f"{root}/versions")
    except AnalysisException as missing:  # no version written yet; any other failure is raised
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    w = Window.partitionBy("dataset").orderBy(F.col("applied_at").desc(), F.col("version").desc())
    rows = (v.where(F.col("dataset") == dataset).withColumn("__r", F.row_number().over(w)).where("__r = 1")
            .collect())
    return rows[0].asDict() if rows else None


def load(spark: SparkSession, root: str, dataset: str, original_path: str, source: str = "working") -> DataFrame:
    """The active (working) version unless ``source == "original"``."""
    if source != "original":
        v = latest_version(spark, root, dataset)
        if v:
            return nan_to_null(spark.read.parquet(v["path"]))
    return read_table(spark, original_path)


def apply_and_save(spark: SparkSession, root: str, dataset: str, original_path: str, steps: list,
                   append: bool = True, fit_scope: str = "all") -> dict:
    """Replay the (appended or replaced) step list from the original plus the saved
    hold-out, write the new version and log it; returns shape and columns."""
    from tabsmith.operators.split import holdout_split
    from tabsmith.operators.steps import apply_steps

    prev = latest_version(spark, root, dataset)
    old_steps = json.loads(prev["steps"]) if prev and append else []
    holdout = json.loads(prev["holdout"]) if prev and prev["holdout"] else None
    base = read_table(spark, original_path)
    if holdout:
        base = holdout_split(base, **holdout)
    all_steps = old_steps + list(steps)
    out = apply_steps(base, all_steps, fit_scope)
    path = f"{root}/data/{dataset}/{uuid.uuid4().hex[:12]}"
    write_version(out, path)
    record_version(spark, root, dataset, path, all_steps, holdout)
    written = spark.read.parquet(path)
    return {"path": path, "n_rows": written.count(), "columns": written.columns}


def save_holdout(spark: SparkSession, root: str, dataset: str, original_path: str, spec: dict) -> dict:
    """Rebuild from the original with the hold-out label, clear the steps, store the spec;
    returns the train / test counts."""
    from tabsmith.operators.split import holdout_split

    base = holdout_split(read_table(spark, original_path), **spec)
    path = f"{root}/data/{dataset}/{uuid.uuid4().hex[:12]}"
    write_version(base, path)
    record_version(spark, root, dataset, path, [], spec)
    counts = spark.read.parquet(path).groupBy(SPLIT_COL).count().collect()
    return {r[SPLIT_COL]: r["count"] for r in counts}


def holdout_status(spark: SparkSession, root: str, dataset: str, df: DataFrame | None = None) -> dict:
    """Whether a hold-out is configured, whether the label column is present in the active
    version, and its train / test counts (one grouped count)."""
    v = latest_version(spark, root, dataset)
    spec = json.loads(v["holdout"]) if v and v["holdout"] else None
    active = df if df is not None else (spark.read.parquet(v["path"]) if v else None)
    present = active is not None and SPLIT_COL in active.columns
    counts = {}
    if present:
        counts = {r[SPLIT_COL]: r["count"] for r in active.groupBy(SPLIT_COL).count().collect() if r[SPLIT_COL]}
    return {"configured": spec is not None, "spec": spec, "column_present": present,
            "n_train": counts.get("train", 0), "n_test": counts.get("test", 0)}


def history(spark: SparkSession, root: str, dataset: str) -> list:
    v = latest_version(spark, root, dataset)
    return json.loads(v["steps"]) if v else []


def reset(spark: SparkSession, root: str, dataset: str, original_path: str) -> dict:
    """Back to the original, keeping the hold-out spec."""
    prev = latest_version(spark, root, dataset)
    holdout = json.loads(prev["holdout"]) if prev and prev["holdout"] else None
    if holdout:
        return save_holdout(spark, root, dataset, original_path, holdout)
    record_version(spark, root, dataset, original_path, [], None)
    return {}
