"""Line de-duplication: lines that many documents share are taken out of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import SPACE, ascii_lower, digest


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               min_chars: int = 1, count_cols: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Drop every line whose key (:func:`line_key`) has at least ``min_chars`` code points and occurs
    in at least ``min_docs`` documents; the other lines keep their order, joined by a line feed.

    Returns all columns of ``docs`` with ``text_col`` replaced, then ``n_lines`` (before) and
    ``n_dropped``, named ``count_cols``; columns of these names in the input are replaced.

    Each row counts as a document, so repeated rows count several times and get the same result.
    A null or empty text is one empty line, which is never dropped; null ids are kept. An empty
    table gives an empty result.

    Plan: line digests are made distinct inside the row and counted with map-side aggregation, so
    a frequent line crosses the network once a task. Digests over the threshold are joined to
    (row key, position); only positions of dropped lines are collected per document, bounded by
    the document itself; the text is shuffled once. Adaptive execution splits the partitions of a
    line that a large part of the documents hold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = F.filter(F.transform(F.split(text, "\n"), line_key), lambda x: F.char_length(x) >= min_chars)
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    row = [F.col(id_col).alias("__ld_id"), digest(F.col(text_col)).alias("__ld_text")]
    common = (docs.select(F.explode_outer(F.array_distinct(F.transform(long_enough, lambda x: F.md5(x)))).alias("k")).where("k IS NOT NULL")
              .groupBy(F.unhex("k").alias("k")).count().where(F.col("count") >= min_docs).select("k"))
    hits = (docs.select(*row, placed.alias("lines")).select("__ld_id", "__ld_text", F.explode_outer("lines").alias("line")).where(F.char_length("line.key") >= min_chars)
            .select("__ld_id", "__ld_text", "line.pos", F.unhex(F.md5("line.key")).alias("k"))
            .join(common, "k").groupBy("__ld_id", "__ld_text").agg(F.collect_set("pos").alias("__ld_gone"))
            .select(F.col("__ld_id").alias("__ld_id2"), F.col("__ld_text").alias("__ld_text2"), "__ld_gone"))
    found = docs.select("*", *row).join(
        hits, F.col("__ld_id").eqNullSafe(F.col("__ld_id2")) & (F.col("__ld_text") == F.col("__ld_text2")), "left")
    found = found.withColumn("__ld_lines", F.split(text, "\n"))  # a column, as an expression would be evaluated for each line
    n = F.size("__ld_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__ld_gone"))
    out = {count_cols[0]: n.cast("long"), count_cols[1]: F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long"),
           text_col: F.when(F.col("__ld_gone").isNull(), text).otherwise(
               F.array_join(F.transform(kept, lambda p: F.get(F.col("__ld_lines"), p)), "\n"))}
    return found.withColumns(out).drop("__ld_id", "__ld_text", "__ld_id2", "__ld_text2", "__ld_gone", "__ld_lines")


def op3_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, rn, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), gone AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rn) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (k.key IN (SELECT key FROM gone)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k.key NOT IN (SELECT key FROM gone)), '')) AS kept_sha256
FROM k GROUP BY rn
"""
