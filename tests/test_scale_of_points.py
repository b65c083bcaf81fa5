"""Selections by digest move few rows."""

from pyspark.sql import functions as F

from tabsmith.functions.columns import row_hash
from tabsmith.functions.ranking import near_first
from tabsmith.operators.profile import feature_target_points


def test_near_first_holds_the_first_rows_and_few_more(spark):
    d = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("g"), row_hash(["id"]).alias("h"))
    near = near_first(d, "h", {"0": 5, "1": 3}, "g", slack=50).collect()
    for g, n in (("0", 5), ("1", 3)):
        first = sorted(r["h"] for r in d.where(F.col("g") == g).collect())
        own = sorted(r["h"] for r in near if r["g"] == g)
        assert n <= len(own) <= n + 50 and own == first[:len(own)]


def test_points_are_the_first_by_digest_of_the_rows_with_values(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 2.0).alias("x"), F.lit(None).cast("double").alias("none"),
                                 F.when(F.col("id") % 5 > 0, F.col("id") + 0.5).alias("y"))
    got = {r["x"] for r in feature_target_points(d, "y", ["x", "none"], 40, key=["id"]).collect()}
    rows = d.where("x IS NOT NULL AND y IS NOT NULL").withColumn("h", row_hash(["id"])).orderBy("h").limit(40)
    assert got == {r["x"] for r in rows.collect()} and len(got) == 40
