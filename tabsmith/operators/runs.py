"""Run comparison, importances and scoring.

Runs carry ``params MAP<STRING,STRING>`` and ``metrics MAP<STRING,DOUBLE>``; every operator is
a query over that table (a handful of rows per experiment, so windows over it are cheap).
Scoring runs the fitted pipeline over the whole input and aggregates per row key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import q

RUN_METRICS = ["rmse", "mae", "r2", "cv_rmse", "train_rmse", "train_mae", "train_r2", "accuracy", "f1_score",
               "roc_auc", "train_accuracy", "train_f1"]
LOWER_BETTER = {"rmse", "mae", "cv_rmse", "train_rmse", "train_mae"}


def list_runs(runs: DataFrame, dataset: str, metrics: Sequence[str] = RUN_METRICS) -> DataFrame:
    """Runs of a dataset, newest first; params coerced to numbers where they parse (the
    ``model`` entry excluded); one column per metric."""
    r = runs.where(F.col("dataset") == dataset)
    params = F.map_filter("params", lambda k, v: k != "model")
    return r.select(
        "run_id", "model", "started_at",
        F.transform_values(params, lambda k, v: v.try_cast("double")).alias("params_numeric"),
        *[F.col("metrics").getItem(m).alias(m) for m in metrics],
    ).orderBy(F.col("started_at").desc(), F.col("run_id"))


def sort_runs(runs: DataFrame, metric: str, direction: str | None = None) -> DataFrame:
    """Order by one metric with missing values last; default direction per metric."""
    d = direction or ("asc" if metric in LOWER_BETTER else "desc")
    v = F.col("metrics").getItem(metric)
    order = v.asc_nulls_last() if d == "asc" else v.desc_nulls_last()
    w = Window.orderBy(order, F.col("run_id"))  # a run list is small (one row per run)
    return runs.select("run_id", "model", v.alias(metric), F.row_number().over(w).alias("position"))


def champion(runs: DataFrame, metric: str = "rmse") -> DataFrame:
    """The run with the best primary metric (missing excluded)."""
    v = F.col("metrics").getItem(metric)
    pick = F.min_by if metric in LOWER_BETTER else F.max_by
    best = F.min(v) if metric in LOWER_BETTER else F.max(v)
    return runs.where(v.isNotNull()).agg(pick(F.col("run_id"), v).alias("run_id"), best.alias(metric))


def _long_metrics(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "model", F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull())


def metric_extremes(runs: DataFrame) -> DataFrame:
    """Best and worst value per metric (direction aware)."""
    lm = _long_metrics(runs)
    lower = F.col("metric").isin(list(LOWER_BETTER))
    g = lm.groupBy("metric").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    return g.select("metric", F.when(lower, F.col("mn")).otherwise(F.col("mx")).alias("best"),
                    F.when(lower, F.col("mx")).otherwise(F.col("mn")).alias("worst"))


def run_vs_champion(runs: DataFrame, run_id: str, primary: str = "rmse", digits: int = 4) -> DataFrame:
    """Per metric of one run: its value, the champion's value, delta, min-max position of the
    run among all runs (0..100, direction aware) and whether it is at least as good."""
    lm = _long_metrics(runs)
    champ = champion(runs, primary).select(F.col("run_id").alias("champ"))
    cv = lm.join(champ, lm.run_id == champ.champ).select("metric", F.col("value").alias("champion_value"))
    rng = lm.groupBy("metric").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    me = lm.where(F.col("run_id") == run_id).select("metric", "value")
    j = me.join(cv, "metric", "left").join(rng, "metric")
    lower = F.col("metric").isin(list(LOWER_BETTER))
    span = F.when(F.col("mx") - F.col("mn") == 0, F.lit(1.0)).otherwise(F.col("mx") - F.col("mn"))
    pct = (F.col("value") - F.col("mn")) / span * 100
    return j.select(
        "metric", F.round("value", digits).alias("value"), F.round("champion_value", digits).alias("champion_value"),
        F.round(F.col("value") - F.col("champion_value"), digits).alias("delta"),
        F.round(F.when(lower, 100 - pct).otherwise(pct), 2).alias("position_pct"),
        F.when(lower, F.col("value") <= F.col("champion_value")).otherwise(F.col("value") >= F.col("champion_value"))
         .alias("is_best"))


def param_compare(runs: DataFrame, run_id: str, n: int = 3) -> DataFrame:
    """Numeric params of a run against up to ``n`` other runs of the same model (newest
    first): long (param, slot, run_id, value); slot 1 is the run itself."""
    me = runs.where(F.col("run_id") == run_id).select("model", "started_at")
    model = me.select("model").scalar()
    others = runs.where((F.col("model") == model) & (F.col("run_id") != run_id))
    w = Window.orderBy(F.col("started_at").desc(), F.col("run_id"))  # runs of one model: a few rows
    others = others.withColumn("slot", F.row_number().over(w) + 1).where(F.col("slot") <= n + 1)
    mine = runs.where(F.col("run_id") == run_id).withColumn("slot", F.lit(1))
    both = mine.unionByName(others)
    keys = mine.select(F.explode(F.map_keys("params")).alias("param"))
    lp = both.select("run_id", F.col("slot").cast("int").alias("slot"), F.explode("params").alias("param", "raw"))
    lp = lp.withColumn("value", F.col("raw").try_cast("double"))
    numeric = (lp.where((F.col("slot") == 1) & F.col("value").isNotNull()).select("param"))
    return lp.join(numeric, "param").join(keys, "param").select("param", "slot", "run_id", "value")


def align_importances(imp: DataFrame) -> DataFrame:
    """Importances of several runs aligned by feature (missing = 0), ranked by the largest
    importance across runs. Long: (feature, run_id, importance, max_importance, rank)."""
    feats = imp.groupBy("feature").agg(F.max("importance").alias("max_importance"))
    # the aligned grid is features x runs of one comparison: a product of two small label sets
    run_ids = imp.select("run_id").distinct().agg(F.sort_array(F.collect_list("run_id"))).scalar()
    grid = feats.select("feature", "max_importance", F.explode(run_ids).alias("run_id"))
    j = grid.join(imp, ["feature", "run_id"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    rk = Window.orderBy(F.col("max_importance").desc(), F.col("feature"))  # one row per feature
    ranks = feats.select("feature", F.dense_rank().over(rk).alias("rank"))
    return j.join(ranks, "feature").select("feature", "run_id", "importance", "max_importance", "rank")


def common_top(imp: DataFrame, k: int = 3) -> DataFrame:
    """Features in EVERY run's top k (by importance, ties by name), plus each run's top 1."""
    w = Window.partitionBy("run_id").orderBy(F.col("importance").desc(), F.col("feature"))
    ranked = imp.withColumn("r", F.row_number().over(w))
    n_runs = imp.select("run_id").distinct().agg(F.count(F.lit(1))).scalar()
    common = ranked.where(F.col("r") <= k).groupBy("feature").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") == n_runs).select("feature", F.lit("common_top").alias("kind"), F.lit(None).cast("string").alias("run_id"))
    top1 = ranked.where("r = 1").select("feature", F.lit("top1").alias("kind"), "run_id")
    return common.unionByName(top1)


def trial_history(trials: DataFrame, direction: str = "minimize") -> DataFrame:
    """Completed trials in order with the running best value."""
    done = trials.where(F.col("state") == "COMPLETE")
    w = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # trials: bounded
    best = F.min("value").over(w) if direction == "minimize" else F.max("value").over(w)
    return done.select("number", "value", best.alias("best_value"))


def feature_importance(model, names: Sequence[str], scales: Sequence[float] | None = None, digits: int = 4):
    """Tree importances, else mean |coefficient| over classes (times the scaler scale in
    parity mode), else uniform; descending. Returns a list of (feature, importance)."""
    import numpy as np

    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        imp = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        imp = np.abs(model.coefficients.toArray())
    elif hasattr(model, "coefs"):
        imp = np.abs(np.array([w for _, w, _ in model.coefs])).mean(axis=0)
    else:
        imp = np.ones(len(names)) / max(len(names), 1)
    if scales is not None:
        imp = imp * np.asarray(scales)
    out = sorted(zip(names, [round(float(v), digits) for v in imp]), key=lambda t: (-t[1], t[0]))
    return out


def score(model, df: DataFrame, digits: int = 4) -> DataFrame:
    """Batch scoring by a model or a saved pipeline (which takes raw rows): prediction, the class name where
    the pipeline knows it, and confidence = max class probability when present."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(df)
    if "probability" in p.columns:
        p = p.withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), digits))
    return p.drop(*[c for c in ("features", "rawPrediction", "probability") if c in p.columns and c not in df.columns])


def score_all(models: dict, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """X11: score the same rows with every run; per row min, max and spread of the predictions. Rows pass once through
    all models that score each row, each of which reads the raw columns; the others are scored apart."""
    whole = {r: m for r, m in models.items() if _scores_each_row(m)}
    parts = [m.transform(df).select(*key, F.col("prediction").alias("__lo"), F.col("prediction").alias("__hi")) for r, m in models.items() if r not in whole]
    if whole:
        rows = df.select(F.struct(*[q(c) for c in df.columns]).alias("__row"))
        names = [f"__p{i}" for i in range(len(whole))]
        for i, m in enumerate(whole.values()):
            rows = m.transform(rows.select("__row.*", "__row", *names[:i])).select("__row", *names[:i], F.col("prediction").alias(names[i]))
        own = [F.col(p) for p in names]
        parts.append(rows.select(*[F.col("__row").getField(k).alias(k) for k in key], (F.least(*own) if len(own) > 1 else own[0]).alias("__lo"),
                                 (F.greatest(*own) if len(own) > 1 else own[0]).alias("__hi")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*key).agg(F.min("__lo").alias("min_pred"), F.max("__hi").alias("max_pred"),
                               (F.max("__hi") - F.min("__lo")).alias("spread"))


def _scores_each_row(model) -> bool:
    """Whether no stage of a model may leave rows out."""
    from pyspark.ml.feature import SQLTransformer

    for stage in getattr(model, "stages", [model]):
        if isinstance(stage, SQLTransformer) or (stage.hasParam("handleInvalid") and stage.getOrDefault("handleInvalid") == "skip"):
            return False
    return True
