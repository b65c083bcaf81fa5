"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but little-endian 16-bit identifiers; a separator ends each document.
Blocks are searched in vectorised form for the separator, and documents that cross a block's
border are put together by a prefix scan over the blocks of a file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Identifiers are stored one higher than in the vocabulary, which frees 0 for the separator.
SEPARATOR, SHIFT = 0, 1
FILE_DOCS = 10_000
BLOCK_TOKENS = 1 << 20
#: Fixed value: the pattern that splits a text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level BPE of a rank file, made once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, text_col: str = "text", tokenizer: str = TOKENIZER) -> None:
    """Tokenise whole texts (null: empty) into token files under ``path``: one file for each
    ``FILE_DOCS`` documents of a scan task, in the order of the scan, without a shuffle. The
    separator is written by the text writer as its line end, so any Spark store will do."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(
                    [(np.array(encode(t), dtype="<u2") + SHIFT).tobytes() if t else b"" for t in texts], pa.binary())], ["value"])

    (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tokens, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\u0000\u0000").option("maxRecordsPerFile", FILE_DOCS).text(path))


def scan_blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n, ends): tokens of each block and the places of separators in it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(content.as_buffer(), dtype="<u2")
                for k in range(0, len(ids), block):
                    part = ids[k:k + block]
                    ends = np.flatnonzero(part == separator)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([k // block], pa.int64()), pa.array([len(part)], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))], ["file", "block", "n", "ends"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(search, "file string, block long, n long, ends array<long>")


def documents_of(blocks: DataFrame) -> DataFrame:
    """(file, number, start, n_tokens, ended): each document of the files, from :func:`scan_blocks`.

    The prefix scan gives each block its place, the number of documents ended before it and the
    last separator before it; only a row per block takes part. Tokens after a file's last
    separator are a document that hasn't ended; an empty file has none; two separators in a row
    hold an empty document."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("number", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
              .withColumn("last", F.when(F.size("ends") > 0, F.col("base") + F.get("ends", F.size("ends") - 1)))
              .withColumn("carry", F.coalesce(F.max("last").over(before), F.lit(-1)))
              .withColumn("final", F.lead("block").over(order).isNull()))
    start = F.when(F.col("i") == 0, F.col("carry") + 1).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    ended = (placed.select("file", "number", "base", "carry", "ends", F.posexplode("ends").alias("i", "end"))
             .select("file", (F.col("number") + F.col("i")).alias("number"), start.alias("start"),
                     (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended")))
    last = F.coalesce("last", "carry")
    rest = (placed.where("final").select("file", (F.col("number") + F.size("ends")).alias("number"), (last + 1).alias("start"),
                                         (F.col("base") + F.col("n") - last - 1).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0"))
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 path: str | None = None) -> DataFrame:
    """(doc_id, file, number, start, n_tokens): write ``docs`` to token files, find the documents in
    them and give them their ids back by file and number. ``docs`` must be a table read from files.

    Null and empty texts have no tokens but a separator; repeated rows and null ids keep their
    rows. An empty table gives no rows. Other columns are ignored. Files have ``FILE_DOCS``
    documents at most; a file is read by one task and searched block by block."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_token_files(docs, path, text_col, tokenizer)
    task = r"part-(\d+)-.*-c(\d+)\."
    found = documents_of(scan_blocks(spark, path))
    found = found.withColumns({"task": F.regexp_extract("file", task, 1).cast("long"),
                               "row": F.regexp_extract("file", task, 2).cast("long") * FILE_DOCS + F.col("number")})
    place = F.monotonically_increasing_id()
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).isNull().alias("_"), place.alias("place"))
    ids = ids.select("doc_id", F.shiftright("place", 33).alias("task"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row"))
    return ids.join(found, ["task", "row"], "left").select(
        "doc_id", F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "number", "start", "n_tokens")


def op10_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_tokens", "start", "number")
