"""Near-duplicates shuffle the texts, sets and buckets that are compared, not all."""

import random

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import common, minhash

DOCS = "doc_id long, text string"


def _shuffled(df):
    """Rows that the exchanges of a frame write when it runs."""
    df.collect()

    def below(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return below(plan.executedPlan())
        if name.endswith("QueryStage"):
            return below(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(below(plan.children().apply(i)) for i in range(plan.children().size()))

    return below(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def joined_by_shuffles(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for broadcasts
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_may_match_keeps_all_that_is_wanted(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("b"))
    wanted = common.stored(rows.where("a % 100 < 2").unionByName(rows.limit(1).select(F.lit(None).cast("long").alias("a"), "b")), "wanted")
    rows = rows.unionByName(wanted.where("a IS NULL"))
    exact = lambda df: df.join(wanted.withColumnsRenamed({"a": "x", "b": "y"}), F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left_semi").count()
    found = common.may_match(rows, wanted, "a", "b")
    assert found.columns == ["a", "b"] and exact(found) == 401 and found.count() < 1200
    assert common.may_match(rows, wanted.limit(0), "a", "b").count() == 0
    assert common.may_match(rows.limit(0), wanted, "a", "b").count() == 0
    monkeypatch.setattr(common, "MOST_BITS", 256)  # too few for the keys: lets others through, loses none
    assert exact(common.may_match(rows, wanted, "a", "b")) == 401


def test_few_candidates_move_few_texts(spark, joined_by_shuffles, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " end") for i in range(20)] + [(3000 + i, rows[0][1]) for i in range(200)]
    moved, plain = {}, common.stored

    def stored(df, name, *parts):
        if name in ("sets", "buckets"):
            moved[name] = _shuffled(df)
        return plain(df, name, *parts)

    monkeypatch.setattr(minhash, "stored", stored)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i for i in range(1500)} | {2000 + i: i for i in range(20)} | {3000 + i: 0 for i in range(200)}
    assert moved["sets"] < 300  # 40 texts share a bucket, of 1,720 rows
    assert moved["buckets"] < 4000  # of 24,320 members of buckets


def test_few_pairs_move_few_sets(spark, joined_by_shuffles):
    sets = common.stored(spark.range(3000).select(F.col("id").cast("string").alias("text"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.floor(F.col("id") / 2) * 100 + x).alias("s")), "sets")
    pairs = [(str(2 * i), i, str(2 * i + 1 + i % 2), i + 100) for i in range(10)]  # every other pair shares nothing
    pairs = common.stored(spark.createDataFrame(pairs, "text string, root long, text2 string, root2 long"), "pairs")
    found = minhash._confirmed(pairs, sets, 85)
    assert _shuffled(found) < 400  # of 3,000 sets, twice
    assert sorted(r["root"] for r in found.collect()) == [0, 2, 4, 6, 8]


def test_buckets_without_a_pair_are_left_out(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 40 + i * 8] + [f"u{i}x{j}" for j in range(i)])) for i in range(20)]  # sizes of differences of many classes
    docs = spark.createDataFrame(rows, DOCS)
    sig = common.stored(minhash.signatures(docs, "doc_id", "text", 5, 16, 4), "signatures")
    hub = sig.where("first_id = 0").first()["text"]
    found = minhash._difference_members(sig.select(F.lit(hub).alias("hub"), "text", "n").where("text != hub"), minhash._sets(docs, sig, sig, "doc_id", "text", 5), 85)
    sides = {}
    for r in found.collect():
        sides.setdefault(r["bucket"], []).append(r["side"])
    assert sides and all(len(s) > 1 and (set(s) == {0} or {-1, 1} <= set(s)) for s in sides.values())
