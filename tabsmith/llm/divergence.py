"""Source divergence audit: how far the word use of each source of a language lies from that of the
other sources, and which terms it uses more than its language does.

Terms are cut and counted by Arrow's own string and hash functions inside ``mapInArrow``; the partial
counts are merged by Spark, and each shard of the merged columns is compared by integer arithmetic."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import stored
from tabsmith.llm.katz import blocks

#: What lies between terms: all ASCII characters but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are cut into terms at a time, and partial counts that a task holds.
BLOCK_BYTES, HELD_ROWS = 1 << 22, 1 << 19
#: Merged counts of a shard, sources compared with all others by one task, cells of a dense block.
SHARD_ROWS, TILE_SOURCES, BLOCK_CELLS = 200_000, 256, 1 << 20
SCALE = 1_000_000_000
PARTIAL = "lang string, source string, term string, n long, docs long"


def block_counts(block: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a block of lang, source and text: occurrences and documents."""
    whole = pa.array(np.arange(block.num_rows))  # Arrow's string functions misread slices
    text, lang, source = (block.column(c).take(whole) for c in ("text", "lang", "source"))
    cut = pc.split_pattern_regex(pc.ascii_lower(text.cast(pa.large_string())), pattern=GAP)
    row, flat = pc.list_parent_indices(cut), pc.list_flatten(cut)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    keys = pa.table({"lang": lang, "source": source, "row": whole}).group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
    own = np.zeros(block.num_rows, dtype=np.int64)
    for g, rows in enumerate(keys["row_list"].to_pylist()):
        own[rows] = g
    by_doc = pa.table({"row": row.filter(real), "term": coded.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    by_doc = by_doc.append_column("group", pa.array(own[by_doc["row"].to_numpy()]))
    summed = by_doc.group_by(["group", "term"], use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    at = summed["group"]
    return pa.table({"lang": keys["lang"].take(at), "source": keys["source"].take(at), "term": coded.dictionary.take(summed["term"]).cast(pa.string()),
                     "n": summed["count_all_sum"].cast(pa.int64()), "docs": summed["count_all"].cast(pa.int64())})


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a partition; what is held is merged, and sent on once it is large."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        out = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for block in blocks(batches, "text", BLOCK_BYTES):
        held.append(block_counts(block))
        if sum(x.num_rows for x in held) > HELD_ROWS:
            held = [merged()]
            if held[0].num_rows > HELD_ROWS // 2:
                yield from held.pop().combine_chunks().to_batches(max_chunksize=20_000)
    if held:
        yield from merged().combine_chunks().to_batches(max_chunksize=20_000)


def probability(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) by long division, three digits at a time, so
    that no product leaves 64 bits; totals up to 9e15."""
    whole = np.asarray(total, dtype=np.int64) + 2 * terms
    out, rest = np.divmod(np.asarray(count, dtype=np.int64) + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); below 64 bits as both are at most SCALE + 1."""
    d = p - q
    return d * d // (p + q)


def compared(key: tuple, counts: pa.Table, sizes: pa.Table, top: int) -> pa.Table:
    """Of one shard of a language's terms and one tile of its sources: partial sums of the pairs, and
    each source's first ``top`` terms. ``sizes`` has every source of the language and marks the tile's."""
    sources, total = sizes["source"].to_pylist(), sizes["total"].to_numpy()
    mine = np.flatnonzero(sizes["mine"].to_numpy(zero_copy_only=False))
    terms, of_lang = (sizes["terms"][0].as_py(), sizes["lang_total"][0].as_py())
    sums = np.zeros((len(mine), len(sources)), dtype=np.int64)
    best = None
    if counts.num_rows:
        number = {s: i for i, s in enumerate(sources)}
        coded = counts["source"].combine_chunks().dictionary_encode()
        source = np.array([number[s] for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        term_codes = counts["term"].combine_chunks().dictionary_encode()
        term, n = term_codes.indices.to_numpy().astype(np.int64), counts["n"].to_numpy()
        p = probability(n, total[source], terms)
        rare = probability(np.zeros(len(sources)), total, terms)
        order = np.argsort(term, kind="stable")
        step = max(1, BLOCK_CELLS // len(sources))
        starts = np.searchsorted(term[order], np.arange(0, len(term_codes.dictionary) + step, step))
        for at, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
            here = order[lo:hi]
            dense = np.tile(rare, (min(step, len(term_codes.dictionary) - at * step), 1))
            dense[term[here] - at * step, source[here]] = p[here]
            for k, a in enumerate(mine):
                sums[k] += gap(dense[:, a:a + 1], dense).sum(axis=0)
        q = probability(counts["lang_n"].to_numpy(), np.full(len(n), of_lang), terms)
        more = np.flatnonzero((p > q) & np.isin(source, mine))
        best = pa.table({"source": counts["source"].take(more), "item": counts["term"].take(more), "value": gap(p[more], q[more])})
        best = best.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
        runs = best["source"].combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.searchsorted(runs, runs) if len(runs) else np.zeros(0, dtype=np.int64)
        best = best.filter(pa.array(np.arange(len(runs)) - first < top))
    left, right = np.nonzero(mine[:, None] != np.arange(len(sources))[None, :])
    names = pa.array(sources, pa.string())
    pairs = pa.table({"source": names.take(pa.array(mine[left])), "item": names.take(pa.array(right)), "value": sums[left, right]})
    parts = [pairs.append_column("part", pa.array(["pair"] * len(pairs), pa.string()))]
    if best is not None:
        parts.append(best.append_column("part", pa.array(["term"] * len(best), pa.string())))
    out = pa.concat_tables([x.select(["source", "part", "item", "value"]) for x in parts])
    return out.add_column(0, "lang", pa.array([key[0].as_py()] * len(out), pa.string()))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) that occurs, its distance from each
    other source of the language (part ``pair``) and the ``top`` terms that it uses more than the
    language (part ``term``). Ranks go by value, then by the item's UTF-8.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language keeps
    those in at least ``min_docs`` of its documents, each row being a document. The probability of a
    kept term is 1 + floor(1e9 * (count + 2) / (N + 2 * V)) and the distance of two the floor of
    (p - q)^2 / (p + q), summed over all kept terms for a pair. All arithmetic is on integers.

    Null texts, langs and sources are empty strings, so null and '' are one group. A group without
    terms has the probabilities of zero counts. Without kept terms every pair's value is 0 and no
    terms are returned. A language with one source has no pairs. Repeated rows count as often as
    they occur. An empty table gives no rows. Other columns are not read.

    Scale: texts never leave their task; a frequent term crosses the network once a task. Counts are
    merged by (lang, source, term), so no language or source is one group. A shard holds about
    ``SHARD_ROWS`` merged counts, a task compares ``TILE_SOURCES`` sources with all others over dense
    blocks of ``BLOCK_CELLS``; shards send sums of pairs and ``top`` terms a source only."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    merged = rows.mapInArrow(partial_counts, PARTIAL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    kept = stored(merged.withColumns({"lang_docs": F.sum("docs").over(every), "lang_n": F.sum("n").over(every),
                                      "first": F.row_number().over(every.orderBy("source")) == 1})
                  .where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"), "kept_terms")
    groups = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    by_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    sizes = stored(groups.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
                   .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms"))), "group_sizes")
    most = sizes.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    shards, tiles = max(1, math.ceil(kept.count() / SHARD_ROWS)), math.ceil(most / TILE_SOURCES)
    tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    left = kept.select("*", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard")).select("lang", "shard", tile, "source", "term", "n", "lang_n")
    right = (sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
             .select("lang", "shard", tile, "source", "total", "lang_total", "terms")
             .withColumn("mine", F.pmod(F.xxhash64("source"), F.lit(tiles)) == F.col("tile")))

    def of_shard(key, counts, own):
        return compared(key, counts, own, top)

    found = (left.groupBy("lang", "shard", "tile").cogroup(right.groupBy("lang", "shard", "tile"))
             .applyInArrow(of_shard, "lang string, source string, part string, item string, value long"))
    found = stored(found, "divergence_shards")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_source_divergence(spark, sf_dir):
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), t AS (SELECT rn, lang, source, unnest(ws) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rn) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (kept.n + 2) // (v.total + 2 * v.v))::BIGINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
