"""CSV null tokens / separator detection, and plan properties of every registered query."""

import os
import tempfile

import pytest

from tabsmith.plans.registry import all_queries
from tabsmith.sources.io import read_csv
from tests.conftest import SF_SMALL

HEAVY = {"d07_train_all_linear", "d07_train_all_classification", "d16_scaler_baseline", "d17_learning_curve",
         "d18_permutation_importance", "h02_tune_trials", "h03_refit_best", "t24_apply_versions",
         "flagship_ridge_metrics", "t22_apply_pipeline_stream", "s01_csv_scan", "s02_read_table_json",
         "s04_list_datasets"}


def test_csv_null_tokens_and_separator(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write('id;x;z;flag\n1;1.5;"a;b";True\n2;NA;nan;False\n3;;NULL;True\n4;-1e3;x;False\n')
    df = read_csv(spark, path, sep="auto")
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "z": "string", "flag": "boolean"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["z"] == "a;b" and rows[2]["x"] is None and rows[2]["z"] is None
    assert rows[3]["x"] is None and rows[3]["z"] is None and rows[4]["x"] == -1000.0


def test_empty_csv_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="tabsmith-csv-")
    path = os.path.join(d, "e.csv")
    with open(path, "w") as f:
        f.write("a,b\n")
    with pytest.raises(ValueError):
        read_csv(spark, path)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - HEAVY))
def test_plan_has_no_pairwise_join_or_python(spark, name):
    plan = all_queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)
