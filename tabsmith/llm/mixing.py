"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source are laid end to end and cut into blocks; its target is a quota of block draws.
The tree deals all quotas exactly among output shards: each node draws how many of every source's
blocks go to its left half. A shard then owns an interval of each source's permuted blocks, disjoint
from all others, and shuffles what it owns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import stored
from tabsmith.llm.packing import with_word_tokens

#: Weights of the sources in code-point order, over and over; share of all words; most uses of a word.
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Words of a block at most, and draws of a source at least (its blocks get smaller for that).
BLOCK_WORDS, LEAST_DRAWS = 8192, 1024
#: Words of an output shard, and draws in all (blocks get larger beyond it: the draws must stay
#: below the 1e9 that numpy's hypergeometric takes).
SHARD_WORDS, MOST_DRAWS = 1 << 22, 1 << 28
#: Rows of a bucket in which one task lays documents end to end, and sources that are broadcast.
BUCKET_ROWS, SMALL_SOURCES, SALTS = 1 << 15, 100_000, 64
NODE = "node long, lo long, hi long, sid array<long>, start array<long>, count array<long>, blocks array<long>"


class Mix(NamedTuple):
    """rows: id, source tag, size, order and copies of all documents; sources: one row each; draws: (shard,
    slot, sid, epoch, block)."""

    rows: DataFrame
    sources: DataFrame
    draws: DataFrame


def rng_of(*key: int) -> np.random.Generator:
    """The generator of a node or a shard: the same in every run and every retry."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([abs(int(k)) for k in key])))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A bijection of [0, ``n``) chosen by ``key``, at ``index``: a Feistel network on the next even number
    of bits, walked until it is back in range. All three are arrays of one length."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, limit, salt = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        h, m, s = half[open_], mask[open_], salt[open_]
        left, right = out[open_] >> h, out[open_] & m
        for r in range(rounds):
            mixed = (right + s + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= limit[open_]]
    return out.astype(np.int64)


def split_nodes(node: dict, draws: int, shards: int, seed: int, levels: int) -> Iterator[dict]:
    """The descendants of a node ``levels`` below it, or its leaves. The left half's counts are one
    multivariate-hypergeometric draw from the node's, so all counts stay exact."""
    lo, hi = node["lo"], node["hi"]
    if hi - lo == 1 or levels == 0:
        yield node
        return
    mid, count, start = (lo + hi) // 2, node["count"], node["start"]
    wanted = mid * draws // shards - lo * draws // shards
    left = rng_of(seed, node["node"]).multivariate_hypergeometric(count, wanted, method="marginals")
    for at, (a, b, own, first) in enumerate(((lo, mid, left, start), (mid, hi, count - left, start + left))):
        some = own > 0
        child = {"node": 2 * node["node"] + at, "lo": a, "hi": b, "sid": node["sid"][some], "start": first[some], "count": own[some], "blocks": node["blocks"][some]}
        yield from split_nodes(child, draws, shards, seed, levels - 1)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield {c: row.column(c)[0].as_py() for c in ("node", "lo", "hi")} | {
                c: row.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sid", "start", "count", "blocks")}


def _node_batch(node: dict) -> pa.RecordBatch:
    lists = {c: pa.ListArray.from_arrays(pa.array([0, len(node[c])], pa.int32()), pa.array(node[c], pa.int64())) for c in ("sid", "start", "count", "blocks")}
    return pa.RecordBatch.from_pydict({c: pa.array([int(node[c])], pa.int64()) for c in ("node", "lo", "hi")} | lists)


def shard_draws(leaf: dict, seed: int) -> dict[str, np.ndarray]:
    """The draws of a shard in its shuffled order: draw number p of a source is block
    permuted(p mod blocks) of round p div blocks."""
    count = leaf["count"]
    sid, blocks = np.repeat(leaf["sid"], count), np.repeat(leaf["blocks"], count)
    p = np.arange(len(sid)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(leaf["start"], count)
    epoch = p // blocks
    key = (sid.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((epoch.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0xA0761D6478BD642F))
    order = rng_of(seed, leaf["lo"], 1 << 40).permutation(len(sid))
    return {"sid": sid[order], "epoch": epoch[order], "block": permuted(p % blocks, blocks, key)[order]}


def _tag(source: Column) -> Column:
    """Sixteen bytes for a source, none for null."""
    return F.when(source.isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.md5(source)))


def targets(sources: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """``sources`` (source, source_size) with sid (rank by code point, null last), weight and target: the
    shares by weight of ``share`` times all words, cut at ``most`` times the source's words, what
    is cut being shared anew until no share is above. Exact; only sums reach the driver."""
    spread = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    spread = stored(spread, "sources")
    before, at = [], 0
    for part, n in sorted(map(tuple, spread.groupBy("part").count().collect())):  # one row a partition
        before.append(F.when(F.col("part") == part, F.lit(at)))
        at += n
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    which = F.pmod(F.col("sid"), F.lit(len(weights))) + 1
    ranked = spread.withColumn("sid", (F.coalesce(*before, F.lit(0)) + inside - 1).cast("long")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), which.cast("int")))
    ranked = stored(ranked.drop("part"), "ranked")
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    words, free = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = Fraction(0)  # words for a weight of 1
    cut = 0
    while free:
        level = (share * (words or 0) - most * cut) / free
        above = size * F.lit(most * level.denominator).cast("decimal(38,0)") <= weight * F.lit(level.numerator).cast("decimal(38,0)")
        now, left = ranked.agg(F.sum(F.when(above, F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if left == free:
            break
        cut, free = now, left
    uncut = F.element_at(F.array(*(F.lit(float(level * w)) for w in weights)), which.cast("int"))
    cap = F.col("source_size").cast("double") * most
    return ranked.withColumn("target", F.least(cap, uncut) if free else cap)


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: Fraction, most: int,
             block_words: int, shard_words: int, seed: int) -> Mix:
    rows = with_word_tokens(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text", "size")
    rows = rows.select("id", "source", (F.col("size") - 1).alias("size"), F.xxhash64(F.lit(seed), "id", F.xxhash64("text")).alias("at"))
    rows = stored(rows.groupBy("id", "source", "size", "at").agg(F.count("*").alias("copies")), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most)
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    block_words = max(block_words, math.ceil(share * words / MOST_DRAWS))
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_DRAWS))).cast("long")
    sources = sources.withColumn("block", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.least(F.col("blocks") * most, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"))).otherwise(0)
    sources = stored(sources.withColumn("quota", quota), "quotas")
    draws = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, min(draws, math.ceil(share * words / shard_words)))
    root = (sources.where("quota > 0").agg(F.sort_array(F.collect_list(F.struct("sid", "quota", "blocks"))).alias("s"))
            .select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("s.sid").alias("sid"),
                    F.transform("s", lambda x: F.lit(0).cast("long")).alias("start"), F.col("s.quota").alias("count"), F.col("s.blocks").alias("blocks")))

    def split(batches):
        for node in _nodes(batches):
            for below in split_nodes(node, draws, shards, seed, 4):
                yield _node_batch(below)

    def dealt(batches):
        for leaf in _nodes(batches):
            own = shard_draws(leaf, seed)
            n = len(own["sid"])
            for at in range(0, n, 50_000):
                to = min(n, at + 50_000)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(to - at, leaf["lo"])), "slot": pa.array(np.arange(at, to)), **{c: pa.array(v[at:to]) for c, v in own.items()}})

    for _ in range(0, (shards - 1).bit_length(), 4):
        root = root.repartition("node").mapInArrow(split, NODE)
    return Mix(rows, sources, root.repartition("node").mapInArrow(dealt, "shard long, slot long, sid long, epoch long, block long"))


def _with_source(df: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns of its source: broadcast where the sources are few, else joined with each
    source spread over ``SALTS`` rows, as one may hold a third of all."""
    own = sources.select(_tag(F.col("source")).alias("__tag"), *columns)
    df = df.withColumn("__own", _tag(F.col("source")))
    if sources.count() <= SMALL_SOURCES:
        return df.join(F.broadcast(own), F.col("__own") == F.col("__tag")).drop("__own", "__tag")
    own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn("__deal", F.pmod("at", F.lit(SALTS)).cast("int"))
    return df.join(own, (F.col("__own") == F.col("__tag")) & (F.col("__deal") == F.col("__salt"))).drop("__own", "__tag", "__deal", "__salt")


def lines_of(mix: Mix) -> DataFrame:
    """(id, source, size, at, copy, sid, block, first, words): the part of each document in each block of its
    source. The place of a document is the words of the buckets before its own plus those before
    it in its bucket; buckets are leading bits of the hash that orders a source's documents."""
    found = _with_source(mix.rows.where("size > 0"), mix.sources, "sid", F.col("block").alias("length"))
    bits = max(0, math.ceil(math.log2(max(1, mix.rows.count()) / BUCKET_ROWS)))
    found = found.withColumn("bucket", F.shiftrightunsigned("at", 64 - bits) if bits else F.lit(0).cast("long"))
    span = F.sum(F.col("size") * F.col("copies"))
    sums = found.groupBy("sid", "bucket").agg(span.alias("sum"))
    sums = sums.select("sid", "bucket", (F.sum("sum").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.join(sums, ["sid", "bucket"]).withColumn("start", F.col("before") + span.over(inside) - F.col("size") * F.col("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    end, length = F.col("start") + F.col("size"), F.col("length")
    found = found.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))))
    first = F.greatest(F.col("start"), F.col("block") * length)
    return found.select("id", "source", "size", "at", "copy", "sid", "block", (first - F.col("start")).alias("first"),
                        (F.least(end, (F.col("block") + 1) * length) - first).alias("words"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
                share: Fraction = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words between ASCII white space), source_size,
    target (words wanted of its source) and taken (words of the document that the mix holds, repeats
    counted, at most ``most`` times its size).

    Sources in code-point order, null last and apart from '', weigh ``weights`` over and over; see
    :func:`targets`. A source's taken words differ from its target by about a block, which is at most
    1 / ``LEAST_DRAWS`` of the target, or one word. A document may be taken in part. Reruns agree:
    all draws come from ``seed``, the order of rows doesn't matter.

    Null and blank texts have no words: size and taken are 0. Null ids and repeated rows are documents
    like others; repeated rows lie next to each other, so their taken may differ by copy. A source
    without words has target 0. An empty table gives no rows. Other columns are not read.

    Scale: texts are read once and don't leave their task. Equal rows are counted before the shuffle.
    Documents are placed by buckets of about ``BUCKET_ROWS``, so a hot source is spread. A node of the
    tree is one row with four numbers for each source that it still holds, a shard's draws are
    made by one task, blocks and draws are joined by (source, block)."""
    mix = plan_mix(docs, id_col, text_col, source_col, weights, share, most, block_words, shard_words, seed)
    times = mix.draws.groupBy("sid", "block").agg(F.count("*").alias("times"))
    key = ["id", "source", "size", "at", "copy"]
    used = lines_of(mix).join(times, ["sid", "block"]).select(*key, (F.col("words") * F.col("times")).alias("taken"))
    every = mix.rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(*key, F.lit(0).cast("long").alias("taken"))
    summed = every.unionByName(used).groupBy(*key).agg(F.sum("taken").alias("taken"))
    return _with_source(summed, mix.sources, "source_size", "target").select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mix_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
              share: Fraction = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """The mix itself: shard, slot (place of the block in its shard), epoch, source, doc_id, first and words
    (the words of the document that stand there). Cases as in :func:`mix_sources`."""
    mix = plan_mix(docs, id_col, text_col, source_col, weights, share, most, block_words, shard_words, seed)
    found = lines_of(mix).join(mix.draws, ["sid", "block"])
    return found.select("shard", "slot", "epoch", "source", F.col("id").alias("doc_id"), "copy", "first", "words")


def op11_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
