"""Helpers shared by the corpus operators: shared scratch tables, text normalisation, row keys
and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, the set [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
#: Bits of ``may_match`` for each key, and at most: 2^20 words of 64 bits, 24 MB, are broadcast.
KEY_BITS, MOST_BITS = 64, 1 << 26


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Only where that setting is unset in a local session (tests) a scratch folder is made and set; on a
    cluster it would be another folder on each machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tabsmith-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/tabsmith/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, in folders by ``parts``, and read it back: the
    plan starts anew from files that survive the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def may_match(rows: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """The rows of ``rows`` whose columns ``names`` may be equal to those of a row of ``wanted``, which is stored: all that
    are and few others, for an exact join that then shuffles only these.

    Hashes of the wanted keys are broadcast as bits. Their number has a limit, beyond which more of the others
    are let through, none of the wanted. Nulls count as equal."""
    bits = min(MOST_BITS, 1 << max(6, (KEY_BITS * wanted.count() - 1).bit_length()))
    place = F.xxhash64(*names).bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    words = wanted.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    return rows.join(F.broadcast(words), (word == F.col("__word")) & (F.getbit("__bits", bit) == 1), "left_semi")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def digest(c: Column) -> Column:
    """128-bit digest of a string as binary; null gives the digest of the empty string."""
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star steps; each step sends a node's smallest neighbour to
    its other neighbours, so the number of rounds grows with the logarithm of the graph, and the
    minimum is aggregated before the shuffle. Each round is written to the shared folder."""
    now = stored(edges.where(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _is_star(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a != b").distinct())
        now = stored(small, name)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one edge to a root that has none: nothing is left to do."""
    several = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return is_empty(several.unionByName(chained))
