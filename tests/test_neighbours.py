"""Exact neighbours against brute force, synthetic rows, and their place in training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith import SPLIT_COL
from tabsmith.operators import neighbours as N
from tabsmith.operators.prep import smote, synthetic_minority
from tabsmith.operators.training import SplitConfig, _balanced, assemble, prepare, train_all


def _brute(x, k):
    d = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(x.shape[1])))
    np.fill_diagonal(d, np.inf)
    return [[int(i) for i in np.lexsort((np.arange(len(x)), row))[:k] if np.isfinite(row[i])] for row in d]


@pytest.mark.parametrize("sizes", [(2048, 512, 4096), (40, 15, 60)])
def test_neighbours_are_exact(spark, sizes, monkeypatch):
    for name, value in zip(("UNIT", "CELL", "VISITS"), sizes):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(3)
    groups = {"a": np.concatenate([rng.normal(size=(300, 3)), 20 + 0.1 * rng.normal(size=(300, 3)), rng.integers(0, 4, size=(1, 3)) + np.arange(80)[:, None]]),
              "b": rng.integers(0, 9, size=(250, 2)) * 1.0 + np.arange(250)[:, None] * 1e-6, "c": np.array([[1.0], [5.0], [2.0]]), "lonely": np.zeros((1, 4))}
    rows = [(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    got = {(r["grp"], r["node"]): [n["node"] for n in r["near"]] for r in N.nearest_in_group(spark.createDataFrame(rows, "grp string, node long, x array<double>"), 5).collect()}
    for g, x in groups.items():
        assert [got[g, i] for i in range(len(x))] == _brute(x, 5), g
    empty = spark.createDataFrame([], "grp string, node long, x array<double>")
    assert N.nearest_in_group(empty).count() == 0


def test_far_units_are_not_visited(spark, monkeypatch):
    """Two heaps far apart: what is compared grows with the heaps, not with their product."""
    monkeypatch.setattr(N, "UNIT", 32)
    monkeypatch.setattr(N, "CELL", 16)
    rng = np.random.default_rng(5)
    x = rng.permutation(np.concatenate([rng.normal(size=(300, 2)), 1000 + rng.normal(size=(300, 2))]))  # numbers in no order, as digests give them
    points = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "grp string, node long, x array<double>")
    units, pivots = N._units(points, points.groupBy("grp").agg(F.count("*").alias("size")))
    places = units.groupBy("grp", "cell", "part").agg(F.max("dist").alias("radius")).join(pivots, ["grp", "cell"]).withColumn("reach", F.lit(1.0))
    n = places.count()
    assert N._unit_pairs(places).count() <= n * n / 2


def test_synthetic_rows(spark):
    rows = [("big", float(i), float(i % 7), i) for i in range(200)] + [("small", 100.0 + i % 20, 3.0 * (i % 3), i) for i in range(33)] + [("one", 7.0, 8.0, 0)]
    rows += [("twins", 5.0, 5.0, i) for i in range(40)] + [("small", None, 1.0, 0), (None, 1.0, 1.0, 0), ("small", float("nan"), 1.0, 0)]
    df = spark.createDataFrame(rows, "label string, x double, y double, grp long").withColumn("node", F.lit("clash"))
    made = synthetic_minority(df, "label", ["x", "y"], seed=1).collect()
    count = {c: sum(r["label"] == c for r in made) for c in ("big", "small", "one", "twins")}
    assert count == {"big": 0, "small": 167, "one": 199, "twins": 160}
    assert {(r["x"], r["y"]) for r in made if r["label"] in ("one", "twins")} == {(7.0, 8.0), (5.0, 5.0)}
    own = sorted({(r[1], r[2]) for r in rows if r[0] == "small" and r[1] is not None and r[1] == r[1]})
    x = np.array(own)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [np.flatnonzero((row <= np.sort(row)[5]) & (row > 0)) for row in d]  # with ties
    for r in (r for r in made if r["label"] == "small"):
        p = np.array([r["x"], r["y"]])
        on = False  # the point lies on the segment from some row to one of its five nearest
        for i, a in enumerate(x):
            for j in near[i]:
                b = x[j] - a
                t = np.clip((p - a) @ b / (b @ b), 0, 1)
                on |= np.linalg.norm(a + t * b - p) < 1e-9
        assert on or any(np.allclose(p, a) for a in x)
    assert sorted(map(tuple, made)) == sorted(map(tuple, synthetic_minority(df.repartition(5), "label", ["x", "y"], seed=1).collect()))
    assert smote(df.limit(0), "label", ["x", "y"]).count() == 0


def test_training_balances_fit_rows_only(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "yes" if i % 8 == 0 else "no", float(rng.normal() + (i % 8 == 0)), float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y string, a double, b double")
    cfg = SplitConfig.from_dict({"imbalance_method": "smote", "key": ["id"], "cv_folds": 2})
    prep = prepare(df.drop("id"), "y", SplitConfig.from_dict({"imbalance_method": "smote"}))
    data = assemble(prep, cfg)
    train = data.where(F.col(SPLIT_COL) == "train")
    sizes = {r["label"]: r["count"] for r in _balanced(train, prep, cfg).groupBy("label").count().collect()}
    before = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert sizes == {c: max(before.values()) for c in before} and min(before.values()) < max(before.values())
    board = train_all(df.drop("id"), "y", models=["logistic_regression"], split_config={"imbalance_method": "smote", "cv_folds": 2}).collect()
    assert board[0]["cv_folds_run"] == 2 and 0 <= board[0]["cv_accuracy"] <= 1
    with pytest.raises(ValueError, match="imbalance_method"):
        train_all(df.drop("id"), "y", models=["logistic_regression"], split_config={"imbalance_method": "adasyn"})
