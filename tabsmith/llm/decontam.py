"""Benchmark decontamination with a positional inverted index over the training documents.

The index holds postings (term, document, position) of the terms that the benchmark's windows are
looked up by: for each window the rarest of its words, by their counts over all documents. Posting
lists are adjusted by the word's offset in the item, so that occurrences of one item passage meet
at the same (document, item, shift); windows whose rarest words all meet are compared word by word
with the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import ascii_lower, digest, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pseudo-term after a document's last word: its posting is the document's length.
END = "\u0000"
#: Tables of short rows (a word, a row key) are broadcast up to this many rows, about 10 MB.
SMALL_ROWS = 200_000


def words_of(text: Column) -> Column:
    """A-Z lower-cased runs of letters, digits and non-ASCII characters; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if its counted rows are few; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def benchmark_items(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item key, item_id, words) of the items that have words."""
    items = bench.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    key = F.concat_ws("\u0001", F.coalesce("item_id", F.lit("\u0002")), F.array_join("words", " "))
    return items.where(F.size("words") > 0).select(digest(key).alias("item"), "item_id", "words").dropDuplicates(["item"])


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): occurrences of each of ``terms`` in all documents."""
    return (docs.select(F.explode_outer(words_of(F.col(text_col))).alias("term")).join(_sized(terms), "term")
            .groupBy("term").agg(F.count("*").alias("n")))


def windows_of(items: DataFrame, counts: DataFrame, size: int = 10, probes: int = 2) -> DataFrame:
    """(item, item_id, words, width, windows): each window has its start and the item positions of its
    ``probes`` rarest words. An item shorter than ``size`` is one window."""
    ranked = (items.select("item", F.posexplode("words").alias("pos", "term")).join(counts, "term", "left")
              .groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("ns")))

    def window(s: Column) -> Column:
        rare = F.array_sort(F.transform(F.slice("ns", s + 1, F.col("width")), lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos"))))
        return F.struct(s.alias("start"), F.transform(F.slice(rare, 1, probes), lambda x: x["pos"]).alias("probes"))

    return (items.join(ranked, "item").withColumn("width", F.least(F.size("words"), F.lit(size)))
            .withColumn("windows", F.transform(F.sequence(F.lit(0), F.size("words") - F.col("width")), window))
            .select("item", "item_id", "words", "width", "windows"))


def probe_positions(windows: DataFrame) -> DataFrame:
    """(item, ipos, term, need): the item positions that some window is looked up by, and how many of
    them each window of the item has."""
    at = F.explode(F.array_distinct(F.flatten("windows.probes"))).alias("ipos")
    need = F.size(F.get("windows.probes", F.lit(0))).alias("need")
    return (windows.select("item", "words", "windows", need).select("item", "words", "need", at)
            .select("item", "ipos", F.get("words", F.col("ipos")).alias("term"), "need"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the postings (term, row, pos) of ``terms`` in all documents. ``row`` numbers the
    documents as they are stored. The posting of the term ``END`` has a document's number of words
    and, with it, doc_id and the digest of the whole text. Postings go from the scan to the file."""
    with_end = _sized(terms.unionByName(docs.sparkSession.createDataFrame([(END,)], "term string")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("doc"),
                       F.concat(words_of(F.col(text_col)), F.array(F.lit(END))).alias("own"))
    tokens = rows.select("row", "doc_id", "doc", F.posexplode_outer("own").alias("pos", "term")).join(with_end, "term")
    last = F.col("term") == END
    return stored(tokens.select("term", "row", "pos", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("doc")).alias("doc")), "postings")


def postings(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") != END).select("term", "row", "pos")


def lengths(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") == END).select("row", "doc_id", "doc", F.col("pos").cast("long").alias("n_words"))


def meetings(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(row, item, shift): offset-adjusted intersection of the posting lists of the rarest words. A
    document position less the item position is the shift; where an item passage stands in a
    document, the lists of a window's words all have its shift."""
    return (postings(index).join(_sized(probes), "term")
            .groupBy("row", "item", (F.col("pos") - F.col("ipos")).alias("shift"))
            .agg(F.count("*").alias("seen"), F.max("need").alias("need")).where("seen >= need").select("row", "item", "shift"))


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int = 3) -> DataFrame:
    """(item_id, row, start, shift): windows whose rarest words all occur with shifts that differ by up
    to ``slop``, that is with so many words put in or left out between them. Frames are of one
    document and item."""
    near = Window.partitionBy("row", "item").orderBy("shift").rangeBetween(0, slop)
    hits = (postings(index).join(_sized(probe_positions(windows)), "term")
            .select("row", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("shift")).withColumn("seen", F.collect_set("ipos").over(near)))
    return (hits.join(windows, "item").select("item_id", "row", "shift", "seen", F.explode("windows").alias("w"))
            .where(F.size(F.array_except("w.probes", "seen")) == 0)
            .groupBy("item_id", "row", F.col("w.start").alias("start")).agg(F.min("shift").alias("shift")))


def phrase_matches(docs: DataFrame, index: DataFrame, windows: DataFrame, probes: DataFrame,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, matches): the exact occurrences (item_id, start, width) of windows in each document that
    has any. Where an item's rarest words meet, its windows are compared word by word."""
    place = F.struct("item_id", "words", "width", "shift")
    found = meetings(index, probes).join(windows.select("item", "item_id", "words", "width"), "item").groupBy("row").agg(F.collect_list(place).alias("found"))
    found = stored(found.join(lengths(index), "row").select("row", F.col("doc_id").alias("c_id"), F.col("doc").alias("c_doc"), "found"), "candidates")
    keys = _sized(found.select("c_id", "c_doc").distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))
    same = lambda b: texts["doc_id"].eqNullSafe(b["c_id"]) & (texts["doc"] == b["c_doc"])
    texts = texts.join(keys, same(keys), "left_semi").dropDuplicates(["doc_id", "doc"])
    own = texts.select("doc_id", "doc", words_of(F.col("text")).alias("own"))

    def checked(c: Column) -> Column:
        equal = lambda s: ((s + c["shift"] >= 0) &
                           (F.slice("own", F.greatest(s + c["shift"], F.lit(0)) + 1, c["width"]) == F.slice(c["words"], s + 1, c["width"])))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(c["words"]) - c["width"]), equal),
                           lambda s: F.struct(c["item_id"].alias("item_id"), (s + c["shift"]).alias("start"), c["width"].alias("width")))

    return (own.join(found, own["doc_id"].eqNullSafe(found["c_id"]) & (own["doc"] == found["c_doc"]))
            .select("row", F.flatten(F.transform("found", checked)).alias("matches")).where(F.size("matches") > 0))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 10, probes: int = 2) -> DataFrame:
    """One row per document: doc_id, doc (digest of the text), n_words, n_hit, items (sorted
    item ids as strings), matches (item_id, start, width) and contaminated.

    A hit word lies inside an occurrence of a window of ``window`` consecutive item words. Null
    and empty texts have no words and no hits; items without words have no windows; null item
    ids never show in ``items`` but their windows hit. Repeated documents each get their row,
    repeated items count once. Empty tables give no rows, or no hits. Other columns are ignored.

    Scale: two scans tokenise the documents, one to count the benchmark's terms, one to write
    postings of the rarest. Word and key tables are broadcast only up to ``SMALL_ROWS`` counted
    rows and shuffled beyond. What is collected per group is bounded by one document or item."""
    items = stored(benchmark_items(bench, text_col=text_col), "items")
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct(), "terms")
    windows = stored(windows_of(items, term_counts(docs, vocabulary, text_col), window, probes), "windows")
    probe = stored(probe_positions(windows), "probes")
    index = build_index(docs, probe.select("term").distinct(), id_col, text_col)
    found = phrase_matches(docs, index, windows, probe, id_col, text_col)
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["width"] - 1))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda x: x.isNotNull())))
    found = found.select("row", "matches", F.size(hit).cast("long").alias("n_hit"), ids.alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return lengths(index).join(found, "row", "left").select(
        "doc_id", "doc", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "matches", (n_hit > 0).alias("contaminated"))


def op2_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT DISTINCT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM b)),
lens AS (SELECT DISTINCT n FROM w),
g AS (SELECT rn, n, s, array_to_string(ws[s:s + n - 1], ' ') AS phrase
      FROM (SELECT rn, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT rn, s, n, item_id FROM g JOIN w USING (n, phrase)),
p AS (SELECT rn, count(DISTINCT i) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS i FROM h) GROUP BY rn),
t AS (SELECT rn, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY rn)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rn) LEFT JOIN t USING (rn)
"""
