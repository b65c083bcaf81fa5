"""A training-corpus pipeline over ``documents``: language identification, line de-duplication,
near-duplicates, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. A stage's result is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import digest, stored
from tabsmith.llm.decontam import SMALL_ROWS, decontaminate
from tabsmith.llm.language_crf import fit_language_model, fold, identify_languages
from tabsmith.llm.line_dedup import line_dedup
from tabsmith.llm.minhash import one_of_each
from tabsmith.llm.packing import best_fit_packing, with_word_tokens

#: Share of a text's words that its language must have.
LEAST_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters (``und``) or without a language that has ``LEAST_SHARE`` of the
    words; ``lang`` becomes the language found.

    Null, empty and letterless texts go. Null ids, sources and languages don't matter; repeated rows
    are judged alike. Without any labelled text there is no language, and every row goes. Further
    columns are kept as they are, whatever their names. An empty table stays empty."""
    model = fit_language_model(docs.where(fold(F.col("doc_id"), 4) != 2))
    names = docs.columns
    found = identify_languages(docs, model, passed=tuple(names), found_cols=("__lang_pred", "__score"))
    return found.where((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_SHARE)).withColumn("lang", F.col("__lang_pred")).select(*names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that at least 10 documents share; ``n_chars`` follows the text.

    Every row stays. A null text becomes the empty one; empty lines stay. Each row counts as a
    document, so a line of ten repeated rows goes from all of them. Further columns are kept, an
    empty table stays empty."""
    return line_dedup(docs, count_cols=("__n_lines", "__n_dropped")).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (Jaccard 0.80 or more), with its smallest id.

    Texts without words are no near-duplicates: one row of each id stays, and every row without an id.
    Of repeated rows one stays. Further columns are kept, an empty table stays empty."""
    return one_of_each(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of 10 words of a ``benchmark`` item occurs.

    Null and empty texts and null ids stay unless their text holds a window; repeated rows are judged
    alike, each by its own text where they share an id. Further columns are kept, an empty table
    stays empty."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = stored(decontaminate(docs, bench).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("doc").alias("hit_doc")).distinct(), "hit")
    hit = F.broadcast(hit) if hit.count() <= SMALL_ROWS else hit
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (digest(docs["text"]) == hit["hit_doc"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents, each with an end token, into sequences.

    Null and empty texts are one end token. Repeated rows are packed as often as they occur, null ids
    too. Only doc_id and text are read; an empty table gives no sequences."""
    return best_fit_packing(with_word_tokens(docs.select("doc_id", "text")), "n_tokens")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
