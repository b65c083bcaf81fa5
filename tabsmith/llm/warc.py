"""WARC archives: writing, and reading by boundary chains.

A scan emits every place that looks like a record start with the place where that record would
end. Only places that the chain from the start of the file reaches are records; a magic string
inside a payload is never reached. The chain is followed by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import is_empty, scratch, stored

#: Fixed values of the WARC 1.0 format.
MAGIC, GAP = "WARC/1.0\r\n", "\r\n\r\n"
#: Digests of repeated payloads are broadcast up to this many counted rows; beyond, pages are shuffled.
SMALL_ROWS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _header(name: str, value: Column) -> Column:
    """One header line; characters that would break it are taken out."""
    return F.concat(F.lit(f"{name}: "), F.translate(value, "\r\n", ""), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a WARC record per row to uncompressed archive files under ``path``.

    The payload is the body in UTF-8 (null: empty). Of records with equal payloads of at least
    ``min_bytes`` the one with the smallest id is a response, the others are revisits without
    payload that refer to it; shorter ones are all responses. Rows that repeat the smallest id are
    responses too; with null ids only, all are. The text writer ends each record with the two line
    ends that the format asks for, so any Spark store will do."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).cast("string").alias("url"),
                        body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    first = (rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n"))
             .where("n > 1 AND first IS NOT NULL").select("digest", F.col("first").cast("string").alias("first")))
    first = stored(first, "first")
    few = first.count() <= SMALL_ROWS
    rows = rows.join(F.broadcast(first) if few else first, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    own = F.coalesce("id", F.lit("null"))
    record = F.concat(
        F.lit(MAGIC), F.when(F.col("again"), F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), own, F.lit(">"))),
        _header("WARC-Target-URI", F.coalesce("url", F.lit("urn:unknown"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(_header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(">"))),
                                        _header("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _header("Content-Length", F.when(F.col("again"), F.lit(0)).otherwise(F.col("size")).cast("string")), F.lit("\r\n"),
        F.when(F.col("again"), F.lit("")).otherwise(F.col("body")))
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): what stands between two magic strings, in file order by block, seq."""
    return (spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"), "value"))


def _field(head: str, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?idm)^{name}:[ \t]*([^\r\n]*)", 1)  # d: only \n ends a line, not U+0085, U+2028, U+2029
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, start, stop, type, id, refers_to, declared, size, complete, digest): every
    possible record with its start and that of its successor (null without a valid header), and
    the digest of the payload where no magic string stands inside it."""
    head = F.substring_index("value", GAP, 1)
    raw = (_segments(spark, path).select("file", "block", "seq", F.octet_length("value").alias("n"), head.alias("head"), F.col("value").cast("binary").alias("value"))
           .withColumn("lead", F.octet_length("head").cast("long"))
           .withColumn("size", F.when(F.col("lead") < F.col("n"), _field("head", "Content-Length").try_cast("long")))
           .withColumn("complete", F.coalesce(F.col("lead") + 4 + F.col("size") + 4 == F.col("n"), F.lit(False))))
    payload = F.substring("value", (F.col("lead") + 5).cast("int"), F.col("size").cast("int"))
    parsed = stored(raw.select(
        "file", "block", "seq", "n", "lead", "size", "complete", _field("head", "WARC-Type").alias("type"), _field("head", "WARC-Record-ID").alias("id"),
        _field("head", "WARC-Refers-To").alias("refers_to"), _field("head", "WARC-Payload-Digest").alias("declared"),
        F.when(F.col("complete"), F.sha2(payload, 256)).alias("digest")), "segments")
    inside = Window.partitionBy("file", "block").orderBy("seq")
    step = F.col("n") + len(MAGIC)
    blocks = parsed.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    blocks = blocks.select("file", "block", (F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base"))
    placed = parsed.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.sum(step).over(inside) - step).join(blocks, ["file", "block"])
    start = F.col("base") + F.col("within") - len(MAGIC)
    return (placed.withColumn("start", start).withColumn("stop", start + len(MAGIC) + F.col("lead") + 4 + F.col("size") + 4)
            .where("start >= 0").drop("base", "within", "seq"))


def reachable(spots: DataFrame) -> DataFrame:
    """(file, start) of the candidates on the chain from the start of each file.

    Each round the set of reached places takes one jump and the jumps double, so the rounds grow
    with the logarithm of the records in a file."""
    jumps = stored(spots.where("stop IS NOT NULL").select("file", "start", F.col("stop").alias("to")), "jumps")
    found = spots.where("start = 0").select("file", "start")
    while True:
        after = found.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        found = stored(found.unionByName(after), "reached")
        ahead = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        jumps = stored(jumps.join(ahead, ["file", "to"]).select("file", "start", F.col("far").alias("to")), "jumps")
        if is_empty(jumps):
            break
    return spots.join(found, ["file", "start"], "left_semi").select("file", "start")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, id, type, refers_to, declared, size, digest) of each record under ``path``;
    digest and size are those of the payload found in the record.

    A file that doesn't begin with a record has none; a record that is cut off or whose header
    lacks its length ends the chain; records are then those before it. Files without any content
    give no rows. Payloads in which magic strings stand are put together from their segments."""
    spots = stored(candidates(spark, path), "candidates")
    spots = spots.withColumn("end", F.max(F.col("start") + len(MAGIC) + F.col("n")).over(Window.partitionBy("file")))
    chain = reachable(spots)
    records = spots.join(chain, ["file", "start"]).where("size IS NOT NULL AND stop <= end")
    whole = records.where("complete").select("file", "start", "id", "type", "refers_to", "declared", "size", "digest")
    parts = stored(records.where("NOT complete").select("file", "start", "stop", "lead", "id", "type", "refers_to", "declared", "size"), "parts")
    if is_empty(parts):
        return whole
    files = parts.select("file").distinct()
    texts = (_segments(spark, path).join(files, "file", "left_semi")
             .withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("seq"))).select("file", "block", "nth", "value"))
    owner = F.last(F.when(F.col("own").isNotNull(), F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    marks = records.select("file", "start", F.lit(True).alias("own"))
    owned = spots.join(files, "file", "left_semi").join(marks, ["file", "start"], "left").withColumn("owner", owner).select("file", "block", "nth", "start", "owner")
    joined = (texts.join(owned, ["file", "block", "nth"]).join(parts.select("file", F.col("start").alias("owner"), F.col("stop").alias("until")), ["file", "owner"])
              .where("start < until").groupBy("file", "owner")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), MAGIC).cast("binary").alias("body")))
    payload = F.substring("body", (F.col("lead") + 5).cast("int"), F.col("size").cast("int"))
    broken = (parts.join(joined.withColumnRenamed("owner", "start"), ["file", "start"])
              .select("file", "start", "id", "type", "refers_to", "declared", "size", F.sha2(payload, 256).alias("digest")))
    return whole.unionByName(broken)


def page_records(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from archives that
    :func:`write_archives` has made; a revisit's payload is that of the response it refers to."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    number = lambda c: F.when(page(c) != "null", page(c)).cast(id_type)
    records = stored(read_archives(spark, path), "records")
    digest = F.when(F.col("type") == "revisit", F.regexp_extract("declared", "sha256:([0-9a-f]+)", 1)).otherwise(F.col("digest"))
    records = records.select(number(F.col("id")).alias("page_id"), "size", digest.alias("payload_digest"), F.col("type").alias("record_type"),
                             number(F.col("refers_to")).alias("refers_to"))
    sizes = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("size").alias("full"))
    revisits = records.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("size", F.col("full")).drop("full")
    return (records.where("record_type = 'response'").unionByName(revisits)
            .select("page_id", F.col("size").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op6_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return page_records(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, sha256(body) AS digest, octet_length(encode(body)) AS n FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN CAST(first AS DOUBLE) END AS refers_to
FROM f
"""
