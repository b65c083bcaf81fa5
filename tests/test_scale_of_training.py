"""Work that is shared by models, trials and copies is done once."""

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import split as S
from tabsmith.operators.search import tune
from tabsmith.operators.training import train_all


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(400).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                (F.col("id") * 7 % 53 + F.col("id") % 37 + 0.5).alias("y"))
    return d.localCheckpoint()


@pytest.fixture
def dealt(monkeypatch):
    calls = []
    plain = S.kfold
    monkeypatch.setattr(S, "kfold", lambda *a, **k: calls.append(1) or plain(*a, **k))
    return calls


def test_models_share_the_folds(rows, dealt):
    cfg = {"val_strategy": "kfold", "cv_folds": 3}
    both = {r["model"]: r["cv_rmse"] for r in train_all(rows, "y", "regression", {}, ["linear_regression", "ridge"], cfg).collect()}
    assert len(dealt) == 1
    one = train_all(rows, "y", "regression", {}, ["ridge"], cfg).first()
    assert one["cv_rmse"] == both["ridge"]


def test_trials_share_the_folds(rows, dealt):
    found = tune(rows, "y", "ridge", 3, "regression", {"cv_folds": 3}).collect()
    assert len(dealt) == 1 and [r["state"] for r in found] == ["COMPLETE"] * 3


def test_a_strategy_that_cannot_be_dealt_fails_the_trials(rows):
    assert {r["state"] for r in tune(rows, "y", "ridge", 2, "regression", {"val_strategy": "loo"}).collect()} == {"FAIL"}
