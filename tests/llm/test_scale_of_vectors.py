"""The vector graph stores and shuffles floats, and only those of a shard's border that a visit may be in range of."""

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import vector_graph
from tabsmith.session import CLEANUP


@pytest.fixture
def tables(monkeypatch):
    seen, plain = {}, vector_graph.stored

    def kept(df, name, *parts):
        seen[name] = plain(df, name, *parts)
        return seen[name]

    monkeypatch.setattr(vector_graph, "stored", kept)
    return seen


def _groups():
    """400 vectors on their own and groups of near copies wide enough to lie in several shards."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(700, 16))
    for g in range(5):
        own = np.arange(400 + 60 * g, 460 + 60 * g)
        off = rng.normal(size=(60, 16))
        x[own] = 4 * x[own[0]] / np.linalg.norm(x[own[0]]) + 1.1 * off / np.linalg.norm(off, axis=1, keepdims=True)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_border_holds_what_a_visit_may_be_in_range_of(spark, tables):
    rows = spark.createDataFrame(_groups(), "vec_id long, embedding array<float>")
    vector_graph.near_vectors(rows, shard=60).count()
    nodes, unit = tables["nodes"].toPandas(), {}
    for r in tables["classes"].collect():
        v = np.array(r["v"], dtype=float)
        unit[r["nid"]] = v / np.linalg.norm(v)
    inside, at_home, next_of, border = defaultdict(set), defaultdict(list), {}, set()
    for shard, nid, rank, near in zip(nodes["shard"], nodes["nid"], nodes["rank"], nodes["next"]):
        if rank < 0:
            border.add((shard, nid))
            continue
        inside[shard].add(nid)
        if rank == 0:
            at_home[shard].append(nid)
            next_of[nid] = near
    asked = {(s, int(b)) for s, own in at_home.items() for n in own for b in next_of[n] if b not in inside[s]}
    nearest = {(s, b): max(unit[b] @ unit[n] for n in at_home[s]) for s, b in asked}
    least = 2 * 0.95 ** 2 - 1  # the cosine of twice the angle
    assert {p for p, c in nearest.items() if c >= least} <= border <= {p for p, c in nearest.items() if c >= least - 0.05}
    assert 0 < len(border) < len(asked) / 2


def test_codes_bound_what_rounding_takes_off(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=n) * s for n in (3, 16) for s in (1e-3, 1.0, 50.0) for _ in range(20)] + [np.array([0.0, 0.0, 2.0])]
    rows = spark.createDataFrame([(i, v.tolist(), float(np.linalg.norm(v))) for i, v in enumerate(x)], "nid long, v array<double>, norm double")
    got = {r["nid"]: bytes(r["code"]) for r in rows.coalesce(1).mapInArrow(vector_graph._codes, "nid long, code binary").collect()}
    assert len(got) == len(x)
    for i, v in enumerate(x):
        scale, off = np.frombuffer(got[i][:8], dtype=np.float32).astype(float)
        back = np.frombuffer(got[i][8:], dtype=np.int8) * scale
        assert len(back) == len(v) and np.linalg.norm(v / np.linalg.norm(v) - back) <= off < 0.02


def test_vectors_of_floats_stay_floats(spark, tables):
    rows = spark.createDataFrame(_groups()[380:460], "vec_id long, embedding array<float>")
    wide = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = {tuple(r) for r in vector_graph.near_vectors(rows).collect()}
    assert {tables[n].schema["v"].dataType.simpleString() for n in ("classes", "nodes")} == {"array<float>"}
    assert {tuple(r) for r in vector_graph.near_vectors(wide).collect()} == out
    assert tables["nodes"].schema["v"].dataType.simpleString() == "array<double>"


def test_shuffle_files_go_when_a_table_is_written(spark):
    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toString().count("shuffle_")
    before = files()
    table = vector_graph.stored(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "trial")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(CLEANUP, "false") == "false"
    assert table.count() == 7
