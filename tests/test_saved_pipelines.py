"""Saved pipelines score raw rows after loading; options; early stopping."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators import runs as X
from tabsmith.operators.models import build_estimator, options
from tabsmith.operators.prep import full_train_codes
from tabsmith.operators.split import holdout_split
from tabsmith.operators.training import SplitConfig, prepare, train_all
from tabsmith.sources.runs import load_model, read_importances, read_runs


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(400):
        city, kind = f"c{rng.integers(0, 6)}", str(rng.choice(["x", "y", "z."], p=[0.6, 0.3, 0.1]))
        a, b = float(rng.normal()), float(rng.normal(5, 3))
        y = 2 * a - b + 3 * (city == "c1") - 2 * (kind == "z.") + float(rng.normal()) * 0.1
        out.append((i, city, kind, a, b, y, ["low", "mid", "high"][int(y > -6) + int(y > -3)]))
    return spark.createDataFrame(out, "id long, city string, kind string, a double, b double, y double, level string").persist()


CONFIGS = [{"scaler": "standard"}, {"scaler": "minmax", "categorical_encoding": "one_hot", "max_category_cardinality": 10}, {"scaler": "robust", "categorical_encoding": "target_encode"},
           {"scaler": "none", "categorical_encoding": "one_hot", "train_pca_components": 2}]


@pytest.mark.parametrize("config", CONFIGS)
def test_loaded_pipeline_scores_raw_rows(spark, rows, config, tmp_path):
    split = holdout_split(rows, "y", 0.25, 1, stratify=False, key=["id"])
    raw = split.select("city", "kind", "a", "b", "y", SPLIT_COL)
    board = {r["model"]: r for r in train_all(raw, "y", "regression", models=["ridge"], split_config=config | {"val_strategy": "none"}, runs_dir=str(tmp_path), dataset="d").collect()}
    model = load_model(spark, str(tmp_path), "d", "ridge")
    scored = X.score(model, split.drop("y"))  # neither the target nor any prepared column
    assert scored.columns[:7] == split.drop("y").columns and "features" not in scored.columns
    error = scored.join(rows.select("id", "y"), "id").groupBy(SPLIT_COL).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("rmse")).collect()
    for r in error:
        assert r["rmse"] == pytest.approx(board["ridge"]["rmse" if r[SPLIT_COL] == "test" else "train_rmse"], abs=1e-4)
    odd = spark.createDataFrame([(None, "new", 1.0, 2.0), ("c1", None, 1.0, 2.0)], "city string, kind string, a double, b double")
    assert all(r["prediction"] == r["prediction"] for r in X.score(model, odd).collect())
    run = read_runs(spark, str(tmp_path)).first()
    found = read_importances(spark, str(tmp_path)).where(F.col("run_id") == run["run_id"]).count()
    assert found == int(run["params"]["n_features"])


@pytest.mark.parametrize("name", ["ridge_classifier", "logistic_regression", "gradient_boosting"])
def test_loaded_classifier_names_classes(spark, rows, name, tmp_path):
    raw = holdout_split(rows, "level", 0.25, 1, key=["id"]).drop("y", "id")
    config = {"val_strategy": "none", "categorical_encoding": "one_hot", "max_category_cardinality": 10}
    board = train_all(raw, "level", "classification", hyperparams={"gradient_boosting": {"n_estimators": 5}}, models=[name], split_config=config, runs_dir=str(tmp_path), dataset="d").first()
    scored = X.score(load_model(spark, str(tmp_path), "d", name), raw)
    assert "confidence" in scored.columns or name != "logistic_regression"
    share = scored.where(f"{SPLIT_COL} = 'test'").agg(F.avg((F.col("predicted_class") == F.col("level")).cast("double"))).first()[0]
    assert share == pytest.approx(board["accuracy"], abs=1e-4)


def test_target_codes_of_all_training_rows(spark, rows):
    """Rows to score get the codes of all training rows, as the test rows do in training; train metrics too."""
    split = holdout_split(rows.select("city", "a", "y"), "y", 0.25, 1, stratify=False, key=["a"])
    prep = prepare(split, "y", SplitConfig.from_dict({"categorical_encoding": "target_encode", "scaler": "none"}), "regression")
    train = split.where(f"{SPLIT_COL} = 'train'").toPandas()
    codes, mean = prep.stages[-1].fitted["city_te"][1:]
    for city, own in train.groupby("city")["y"]:
        var, n = train["y"].var(ddof=0), len(own)
        share = var * n / (var * n + own.var(ddof=0))
        assert codes[city] == pytest.approx(share * own.mean() + (1 - share) * train["y"].mean())
    assert mean == pytest.approx(train["y"].mean())
    seen = {r[0] for r in prep.scoring.select(F.round("city_te", 9)).distinct().collect()}
    assert seen == {round(v, 9) for v in codes.values()}
    assert prep.frame.where(f"{SPLIT_COL} = 'train'").select(F.round("city_te", 9)).distinct().count() > len(codes)  # out-of-fold for the fit
    binary = full_train_codes(rows.withColumn("t", F.when(F.col("a") > 0, "p").otherwise("n")), "t", ["kind"], "classification")
    assert list(binary) == ["kind_te"] and all(0 <= v <= 1 for v in binary["kind_te"][1].values())


def test_unknown_and_unserved_options_are_errors():
    assert options("regression", "ridge", {"alpha": "2"})["alpha"] == 2.0
    assert options("classification", "random_forest", {"max_depth": 0, "bootstrap": "no", "criterion": "log_loss"})["bootstrap"] is False
    for task, model, given in (("regression", "ridge", {"alfa": 1}), ("regression", "decision_tree", {"ccp_alpha": 0.1}), ("classification", "random_forest", {"min_samples_split": 5}),
                               ("regression", "random_forest", {"criterion": "absolute_error"}), ("classification", "decision_tree", {"criterion": "mse"}),
                               ("regression", "logistic_regression", {}), ("classification", "gradient_boosting", {"n_estimators": "many"})):
        with pytest.raises(ValueError):
            options(task, model, given)
    with pytest.raises(ValueError, match="penalty"):
        build_estimator("logistic_regression", "classification", {"logistic_regression": {"penalty": "l3"}})


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_stops_early_on_noise(spark, task):
    rng = np.random.default_rng(1)
    data = [(float(rng.integers(0, 2)), float(rng.normal()), float(rng.normal())) for _ in range(400)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(data, "label double, a double, b double"))
    hyper = {"n_estimators": 30, "max_depth": 4, "learning_rate": 0.5}
    whole = build_estimator("gradient_boosting", task, {"gradient_boosting": hyper}).fit(df)
    short = build_estimator("gradient_boosting", task, {"gradient_boosting": hyper | {"n_iter_no_change": 5, "validation_fraction": 0.3}}).fit(df)
    assert whole.getNumTrees == 30 > short.getNumTrees
