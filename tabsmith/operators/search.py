"""Hyper-parameter search (H02) and refit of the best trial.

Candidates are drawn deterministically from a seeded digest per (trial, parameter), so a
study is reproducible. Trials are independent Spark jobs over one persisted, assembled
DataFrame and run concurrently from a small thread pool (the cluster runs their tasks in
parallel). The objective is the cross-validated score on the training rows by default
(``objective_on="cv"``) or the hold-out test score (``"test"``, as the reference does).
"""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators.models import options
from tabsmith.operators.training import SplitConfig, assemble, cross_validate, deal_folds, fit_and_score, prepare

# The search space per model (low, high, step / log / choices), without the options that Spark's
# trees don't have (min_samples_split, ccp_alpha).
SEARCH_SPACES = {
    "random_forest": {"n_estimators": ("int", 50, 400, 10), "max_depth": ("int", 2, 20, 1),
                      "min_samples_leaf": ("int", 1, 10, 1),
                      "max_features": ("cat", ["sqrt", "log2", "none"])},
    "gradient_boosting": {"n_estimators": ("int", 50, 300, 10), "learning_rate": ("log", 0.01, 0.3),
                          "max_depth": ("int", 2, 8, 1), "subsample": ("float", 0.5, 1.0),
                          "min_samples_leaf": ("int", 1, 10, 1)},
    "decision_tree": {"max_depth": ("int", 2, 20, 1), "min_samples_leaf": ("int", 1, 10, 1)},
    "ridge": {"alpha": ("log", 0.001, 100.0)},
    "logistic_regression": {"C": ("log", 0.001, 100.0), "max_iter": ("int", 200, 2000, 100)},
    "ridge_classifier": {"alpha": ("log", 0.001, 100.0)},
    "linear_regression": {},
}


def _u(seed: int, trial: int, name: str) -> float:
    h = hashlib.md5(f"{seed}~{trial}~{name}".encode()).hexdigest()
    return int(h[:13], 16) / float(16 ** 13)


def draw(model: str, trial: int, seed: int = 42) -> dict:
    """Parameter values of one trial."""
    out = {}
    for name, spec in SEARCH_SPACES.get(model, {}).items():
        u = _u(seed, trial, name)
        if spec[0] == "int":
            lo, hi, step = spec[1], spec[2], spec[3]
            out[name] = lo + step * min(int(u * ((hi - lo) // step + 1)), (hi - lo) // step)
        elif spec[0] == "float":
            out[name] = spec[1] + u * (spec[2] - spec[1])
        elif spec[0] == "log":
            out[name] = math.exp(math.log(spec[1]) + u * (math.log(spec[2]) - math.log(spec[1])))
        else:
            out[name] = spec[1][min(int(u * len(spec[1])), len(spec[1]) - 1)]
    return out


def tune(df: DataFrame, target: str, model: str, n_trials: int = 30, task: str | None = None,
         split_config: dict | SplitConfig | None = None, objective_on: str = "cv", parallelism: int = 4,
         seed: int = 42) -> DataFrame:
    """Run ``n_trials`` candidates; returns the trials table (number, value, state, params)
    where value is RMSE (regression, minimised) or -accuracy (classification)."""
    cfg = split_config if isinstance(split_config, SplitConfig) else SplitConfig.from_dict(split_config)
    if objective_on == "test":
        cfg.val_strategy = "none"
    prep = prepare(df, target, cfg, task)
    data = assemble(prep, cfg)
    train = data.where(F.col(SPLIT_COL) == "train")

    for t in range(n_trials):
        options(prep.task, model, draw(model, t, seed))  # an option that the model lacks is an error, not a failed trial

    folds = None
    if objective_on == "cv":
        try:
            folds = deal_folds(prep, train, cfg)
        except Exception:  # noqa: BLE001 - a strategy that can't be dealt fails the trials, which then deal it themselves
            folds = None

    def run(t):
        params = draw(model, t, seed)
        hyper = {model: params}
        try:
            if objective_on == "cv":
                r = cross_validate(model, prep, train, hyper, cfg, folds)
                value = r["cv_rmse"] if prep.task == "regression" else -r["cv_accuracy"]
            else:
                r = fit_and_score(model, prep, data, hyper, cfg)
                value = r["rmse"] if prep.task == "regression" else -r["accuracy"]
            return (t, float(value), "COMPLETE", {k: str(v) for k, v in params.items()})
        except Exception:  # noqa: BLE001 - a failing candidate is a failed trial, not a failed study
            return (t, None, "FAIL", {k: str(v) for k, v in params.items()})

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(run, range(n_trials)))
    if folds:
        folds.unpersist()
    prep.frame.unpersist()
    return df.sparkSession.createDataFrame(rows, "number int, value double, state string, params map<string,string>")


def refit_best(df: DataFrame, target: str, model: str, trials: DataFrame, task: str | None = None,
               split_config: dict | SplitConfig | None = None, runs_dir: str | None = None,
               dataset: str = "dataset") -> dict:
    """Refit the best completed trial on the training rows, score train / test and log the
    run tagged as tuning."""
    best = trials.where(F.col("state") == "COMPLETE").orderBy(F.col("value").asc(), F.col("number")).first()
    if best is None:
        raise ValueError("no completed trial")
    spec = SEARCH_SPACES.get(model, {})
    params = {}
    for k, v in best["params"].items():
        kind = spec.get(k, ("cat",))[0]
        params[k] = int(v) if kind == "int" else float(v) if kind in ("float", "log") else v
    cfg = split_config if isinstance(split_config, SplitConfig) else SplitConfig.from_dict(split_config)
    cfg.val_strategy = "none"
    prep = prepare(df, target, cfg, task)
    data = assemble(prep, cfg)
    res = fit_and_score(model, prep, data, {model: params}, cfg)
    fitted = res.pop("fitted")
    importances = res.pop("importances", None)
    if runs_dir:
        from tabsmith.sources.runs import log_importances, log_run
        run_id = log_run(df.sparkSession, runs_dir, dataset, model, prep.task, cfg, {model: params}, res, fitted, prep,
                tags={"source": "tuning", "best_trial": str(best["number"])})
        log_importances(df.sparkSession, runs_dir, run_id, importances or [])
    prep.frame.unpersist()
    res["params"] = params
    res["best_trial"] = best["number"]
    return res

