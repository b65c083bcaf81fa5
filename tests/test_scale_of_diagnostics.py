"""Diagnostics and scoring deal narrow rows, once."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabsmith.operators import diagnostics as D
from tabsmith.operators.runs import score_all


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 3 % 11).cast("double").alias("b"),
                               (F.col("id") % 7 + F.col("id") % 5 + 0.5).alias("label"), F.lit("x").alias("other"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d.coalesce(1)).localCheckpoint()


@pytest.fixture
def ranked(monkeypatch):
    seen = []
    plain = D.hash_rank
    monkeypatch.setattr(D, "hash_rank", lambda df, digest, groups=(), **k: seen.append((set(df.columns), list(groups))) or plain(df, digest, groups, **k))
    return seen


def test_permutation_ranks_rows_once_and_donors_narrow(rows, ranked):
    m = LinearRegression(labelCol="label").fit(rows)
    out = D.permutation_importance(m, rows, ["a", "b"], "regression", repeats=2, key=["id"]).collect()
    assert {r["feature"] for r in out} == {"a", "b"} and out[0]["feature"] == "a"
    assert ranked == [({"a", "b", "label", "__ha"}, []), ({"__copy", "__hb", "__pv"}, ["__copy"])]


def test_learning_curve_ranks_what_is_read(rows, ranked):
    out = D.learning_curve(rows, "ridge", "regression", fractions=(0.5, 1.0), key=["id"]).collect()
    assert [r["train_size"] for r in out] == [15, 30]
    assert all(cols <= {"features", "label", "__h", "__h2"} for cols, _ in ranked)


def test_learning_curve_ranks_once_and_caches_nothing(rows, ranked, monkeypatch):
    """Folds and nested subsets by digest order, against ridge by hand; fits and scores read a stored table."""
    cached = []
    monkeypatch.setattr(type(rows), "persist", lambda df, *a: cached.append(df) or df)
    out = D.learning_curve(rows, "ridge", "regression", fractions=(0.3, 1.0), key=["id"]).collect()
    assert not cached and len(ranked) == 1

    def order(ids, seed):
        return sorted(ids, key=lambda i: hashlib.md5(f"{i}~{seed}".encode()).hexdigest())

    data = {r["id"]: (r["features"].toArray(), r["label"]) for r in rows.collect()}
    fold = {i: n % 2 for n, i in enumerate(order(data, 42))}
    for row, size in zip(out, (9, 30)):
        scores = []
        for f in range(2):
            own = order([i for i in data if fold[i] != f], 43)[:size]
            x, y = (np.array(v, dtype=float) for v in zip(*(data[i] for i in own)))
            w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
            error = {i: data[i][1] - y.mean() - (data[i][0] - x.mean(0)) @ w for i in data}
            scores.append([np.sqrt(np.mean([error[i] ** 2 for i in ids])) for ids in (own, [i for i in data if fold[i] == f])])
        assert (row["train_size"], row["train_score"], row["val_score"]) == (size, *(pytest.approx(v, abs=2e-4) for v in np.mean(scores, axis=0)))


def test_rows_pass_once_through_all_models(rows):
    lr = {n: LinearRegression(labelCol="label", regParam=r, solver="normal").fit(rows) for n, r in (("p", 0.0), ("q", 2.0))}
    out = score_all(lr, rows, ["id"])
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r["id"]: (r["prediction"], s["prediction"]) for r, s in zip(lr["p"].transform(rows).collect(), lr["q"].transform(rows).collect())}
    assert all(r["min_pred"] == min(want[r["id"]]) and r["max_pred"] == max(want[r["id"]]) for r in out.collect())


def test_a_model_that_leaves_rows_out_is_scored_apart(rows):
    some = Bucketizer(splits=[0.0, 3.0, 20.0], inputCol="a", outputCol="prediction", handleInvalid="skip")
    gone = rows.withColumn("a", F.when(F.col("id") > 0, F.col("a")))
    out = score_all({"some": some, "all": Bucketizer(splits=[0.0, 5.0, 40.0], inputCol="b", outputCol="prediction")}, gone, ["id"])
    assert out.count() == 60
