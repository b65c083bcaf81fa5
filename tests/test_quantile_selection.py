"""Quantiles by selection against numpy: ties, heavy tails, tiny groups, no ``percentile`` in the default plans."""

import numpy as np

from tabsmith.functions import stats as S
from tabsmith.operators import profile as P


def test_selection_equals_numpy(spark):
    rng = np.random.default_rng(7)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, size=2500) * 1.0, "one": np.array([4.5]), "two": np.array([-1.0, 2.0]),
              "tail": np.concatenate([rng.lognormal(0, 8, size=1500), [1e300, -1e300]]), "equal": np.full(40, -0.25), "tiny": np.array([0.0, 5e-324, 1e-310, 1.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("none", None), ("ties", float("nan"))]
    long = spark.createDataFrame(rows, "column string, value double")
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = S.selected_quantiles(long, "column", "value", probs)
    assert set(got) == set(groups)
    for g, x in groups.items():
        ordered = np.sort(x)
        want = [float(ordered[int(np.floor(p * (len(x) - 1)))] + (ordered[int(np.ceil(p * (len(x) - 1)))] - ordered[int(np.floor(p * (len(x) - 1)))]) * (p * (len(x) - 1) % 1)) for p in probs]
        assert np.allclose(got[g], want, rtol=1e-12, atol=0), g
    assert S.selected_quantiles(long.limit(0), "column", "value", probs) == {}


def test_few_bins_take_more_passes_and_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "PASS_BINS", 40)
    x = np.random.default_rng(1).normal(size=800)
    long = spark.createDataFrame([("a", float(v)) for v in x], "column string, value double")
    assert np.allclose(S.selected_quantiles(long, "column", "value", (0.25, 0.5, 0.75))["a"], np.quantile(x, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_no_value_sets_in_the_default_plans(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 7 as double) AS a", "string(id % 3) AS c")
    for out in (P.column_stats(df), P.outliers(df), P.box_stats(df), P.target_numeric(df, "a"), P.feature_target_classes(df, "c")):
        assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_by_digest(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tabsmith.functions import ranking as R

    rows = [(g, i if i % 5 else 0, i) for g, n in (("a", 400), ("b", 37), ("c", 1), (None, 20)) for i in range(n)]  # a fifth are repeated keys
    df = spark.createDataFrame(rows, "g string, key long, id long").withColumn("h", F.md5(F.concat_ws("~", F.coalesce("g", F.lit("")), "key")))
    local = df.collect()
    for most in (200_000, 50):  # passes of many digits, and of one
        monkeypatch.setattr(R, "PASS_PREFIXES", most)
        for share in (0.0, 0.01, 0.3, 0.77, 1.0, 2.0):
            wanted = {g: int(share * sum(r["g"] == g for r in local)) for g in ("a", "b", "c", None)}
            got = R.first_by_digest(df, "h", wanted, "g").collect()
            assert len(got) == len(rows)
            for g, n in wanted.items():
                own = sorted(r["h"] for r in local if r["g"] == g)
                assert sorted(r["h"] for r in got if r["g"] == g and r["first"]) == own[:n], (g, share)
    n = len(rows) // 3
    assert sorted(r["h"] for r in R.first_by_digest(df, "h", {None: n}).where("first").collect()) == sorted(r["h"] for r in local)[:n]


def test_holdout_moves_and_keeps_no_rows(spark):
    from tabsmith.operators.split import holdout_split

    df = spark.range(500).selectExpr("id", "cast(id % 3 as string) AS c", "cast(id as double) AS y")
    for out in (holdout_split(df, "y", 0.2, 1, stratify=False, key=["id"]), holdout_split(df, "c", 0.2, 1, key=["id"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "InMemoryRelation" not in plan
        assert out.groupBy("__ml_split__").count().collect() and out.where("__ml_split__ = 'test'").count() == 100
