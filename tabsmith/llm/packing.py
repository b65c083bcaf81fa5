"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Pieces are taken from the longest to the
shortest and put into the open sequence of any length that they fill best; if none has room, the
length of least cost per token that holds the piece is opened. At the end every sequence is
downsized to the cheapest length that holds its contents."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import SPACE, stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens of a shard: what one task packs at a time.
SHARD_TOKENS = 1 << 20


def sequence_cost(length: int) -> float:
    """Cost of a sequence: its tokens, 128 for starting it, and attention that grows with the square
    (as much as the tokens at 32,768). Cost per token is least at 2,048."""
    return length + 128 + length * length / 32768


def pack(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> list[tuple[int, list[int]]]:
    """(capacity, indices of ``lengths``) of each bin; ``lengths`` go down and fit the largest capacity.

    The joint choice of sizes is made by trying each permitted ceiling for opened bins (a longer
    piece opens the smallest size that holds it) and keeping the packing of least cost."""
    best, best_cost = [], math.inf
    sizes = sorted(capacities)
    for ceiling in sizes:
        bins, room, mask = [], {}, 0  # room: free tokens -> open bins; mask: a bit for each key of room
        usable = [c for c in sizes if c <= ceiling]
        for i, n in enumerate(lengths):
            above = mask >> n
            if above:
                free = n + (above & -above).bit_length() - 1
                b = room[free].pop()
                if not room[free]:
                    mask ^= 1 << free
            else:
                fits = [c for c in usable if c >= n] or [min(c for c in sizes if c >= n)]
                free = min(fits, key=lambda c: (cost(c) / c, -c))
                b = len(bins)
                bins.append([])
            bins[b].append(i)
            room.setdefault(free - n, []).append(b)
            mask |= 1 << (free - n)
        sized = [(min((c for c in sizes if c >= sum(lengths[i] for i in own)), key=lambda c: (cost(c), c)), own) for own in bins]
        total = sum(cost(c) for c, _ in sized)
        if total < best_cost:
            best, best_cost = sized, total
    return best


def pieces_of(docs: DataFrame, length_col: str, id_col: str, largest: int) -> DataFrame:
    """(doc_id, start, length, copy): each document cut into pieces of ``largest`` tokens and a rest.
    Repeated rows are numbered by ``copy``."""
    n = F.col("n")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / largest).cast("long") - 1),
                        lambda i: F.struct((i * largest).alias("start"), F.least(F.lit(largest), n - i * largest).alias("length")))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(length_col).cast("long").alias("n")).where("n > 0")
            .groupBy("doc_id", "n").agg(F.count("*").alias("copies")))
    return (rows.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select("doc_id", "copy", F.explode(parts).alias("p")).select("doc_id", "copy", "p.start", "p.length"))


def best_fit_packing(docs: DataFrame, length_col: str, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES,
                     cost: Callable[[int], float] = sequence_cost, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per sequence: shard, bin, capacity, n_tokens, cost, n_pieces, doc_ids (of its pieces in
    order) and pieces (doc_id, start, length).

    Every token of every document lies in exactly one piece, every piece in exactly one sequence.
    Documents longer than the largest capacity are cut there; lengths that are null, zero or
    negative have no pieces. Repeated rows are packed as often as they occur; null ids are kept.
    Ties are broken by id and start, so the result doesn't depend on the order of rows. An empty
    table gives no sequences. Other columns are ignored.

    Scale: pieces are dealt by hash into shards of about ``shard_tokens`` tokens, whose number
    follows the total; a shard is packed by one task. A shard leaves a few half-filled sequences,
    which are downsized."""
    largest = max(capacities)
    pieces = stored(pieces_of(docs, length_col, id_col, largest), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    id_type = pieces.schema["doc_id"].dataType
    piece = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("capacity", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("n_pieces", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("pieces", T.ArrayType(piece))])
    sizes = tuple(capacities)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("copy", "ascending")])
        lengths = table["length"].to_pylist()
        rows = table.select(["doc_id", "start", "length"]).to_pylist()
        shard = table["shard"][0].as_py()
        out = [{"shard": shard, "bin": b, "capacity": c, "n_tokens": sum(lengths[i] for i in own), "cost": float(cost(c)), "n_pieces": len(own),
                "doc_ids": [rows[i]["doc_id"] for i in own], "pieces": [rows[i] for i in own]} for b, (c, own) in enumerate(pack(lengths, sizes, cost))]
        kind = table.schema.field("doc_id").type
        at = pa.struct([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64())])
        return pa.Table.from_pylist(out, pa.schema([
            ("shard", pa.int64()), ("bin", pa.int64()), ("capacity", pa.int64()), ("n_tokens", pa.int64()), ("cost", pa.float64()),
            ("n_pieces", pa.int64()), ("doc_ids", pa.list_(kind)), ("pieces", pa.list_(at))]))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(packed, schema)


def with_word_tokens(docs: DataFrame, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of words between ASCII white space and one end-of-document token."""
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE))
    return docs.withColumn(name, F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long") + 1)


def op1_best_fit_packing(spark, sf_dir):
    docs = with_word_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return best_fit_packing(docs, "n_tokens")
