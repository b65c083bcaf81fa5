"""MinHash near-duplicates with circulant signatures, banding and exact verification.

Two permutations make all coordinates: the first scatters the shingles over [0, 2^62), the second
is applied after a circular shift by the coordinate's number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import SPACE, ascii_lower, connected_components, digest, is_empty, may_match, stored

RING = (1 << 62) - 1
#: Rows that are broadcast.
SMALL_ROWS = 100_000
#: Nodes of a bucket of rare differences that all others are compared with in one turn.
HUBS = 16
#: Relative width of a class of sizes.
CLASS_WIDTH = 0.2


def word_list(text: Column) -> Column:
    """A-Z lower-cased words between ASCII white space; none for null or blank texts."""
    t = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def shingle_set(name: str, k: int = 5) -> Column:
    """Distinct 64-bit digests of the ``k``-word shingles; a shorter text is one shingle. Takes the
    name of a column of words: an expression would be evaluated again for each word."""
    words = F.col(name)
    each = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return (F.when(F.size(words) >= k, F.array_distinct(each))
            .when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, "\n"))))
            .otherwise(F.array().cast("array<bigint>")))


def coordinate(shingle: Column, number: int) -> Column:
    """The second permutation at the first one's place, shifted round the ring by ``number``."""
    first = F.xxhash64(shingle, F.lit(1)).bitwiseAND(F.lit(RING))
    return F.xxhash64((first + F.lit(number)).bitwiseAND(F.lit(RING)))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(text, n, first_id, bands): per distinct text with words its digest, the size of its shingle
    set, the smallest id and a hash of each band. Minima are aggregated before the shuffle, so
    a text with many copies crosses the network once a task. Sets are spread by the outer form of
    explode: for the inner form Spark would make each set once more, in a filter."""
    sets = (docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text"), word_list(F.col(text_col)).alias("w"))
            .select("id", "text", shingle_set("w", k).alias("s"))
            .select("id", "text", F.size("s").alias("n"), "s").select("id", "text", "n", F.explode_outer("s").alias("s")).where("s IS NOT NULL"))
    minima = sets.groupBy("text").agg(F.max("n").alias("n"), F.min("id").alias("first_id"),
                                      *(F.min(coordinate(F.col("s"), i)).alias(f"c{i}") for i in range(bands * rows)))
    band = [F.xxhash64(F.lit(b), *(F.col(f"c{b * rows + r}") for r in range(rows))) for b in range(bands)]
    return minima.select("text", "n", "first_id", F.array(*band).alias("bands"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85,
                    bands: int = 16, rows: int = 4) -> DataFrame:
    """All columns of ``docs``, then n_shingles, component_id and kept (columns of these names in the
    input are replaced).

    Documents are linked if 100 * |A and B| >= ``percent`` * |A or B| for their sets of ``k``-word
    shingles; ``component_id`` is the smallest id that links reach, ``kept`` says whether it is the
    row's own. With 16 bands of 4 coordinates a pair at similarity 0.85 is missed with a
    probability under 1e-5; every link is confirmed on the full sets.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat an
    id are the same document: they share its class. A null id is never the smallest; in a class
    without any id, component_id is null and every row is kept. An empty table stays empty.

    Scale: equal texts are one node. All nodes of a bucket are compared with one node, its hub; buckets
    whose nodes have all met in one component are done, as links inside a component can't change the result.
    What is left is dealt anew by rare differences from the hub (see :func:`_difference_members`) and compared
    with ``HUBS`` nodes of such a bucket at a time; the pairs of a bucket are never formed. Shingle sets are
    made only for nodes that share a bucket. Texts, sets and buckets that a join doesn't need are left out before
    they are shuffled (see ``common.may_match``), so a turn moves what it compares and not all sets."""
    nodes = _classes(docs, id_col, text_col, k, percent, bands, rows)
    low = nodes.groupBy("root").agg(F.min("first_id").alias("__nd_component"))
    nodes = nodes.join(low, "root").select(F.col("text").alias("__nd_text"), F.col("n").alias("__nd_n"), "__nd_component")
    own = docs.withColumn("__nd_own", digest(F.col(text_col)))
    out = own.join(nodes, F.col("__nd_own") == F.col("__nd_text"), "left")
    component = F.when(F.col("__nd_n").isNull(), F.col(id_col)).otherwise(F.col("__nd_component"))
    return (out.withColumns({"n_shingles": F.coalesce("__nd_n", F.lit(0)).cast("long"), "component_id": component,
                             "kept": component.isNull() | F.coalesce(F.col(id_col) == component, F.lit(False))})
            .drop("__nd_own", "__nd_text", "__nd_n", "__nd_component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                bands: int = 22, rows: int = 4) -> DataFrame:
    """One row of each class of near-duplicates, linked as in ``near_duplicates``: one with its smallest
    id, also if rows repeat or the class has no id. With 22 bands of 4 coordinates a pair at
    similarity 0.80 is missed with a probability under 1e-5.

    Texts without shingles are linked with nothing: one row of each id stays, and every row without
    an id. Rows are told apart by id and text; the texts are shuffled only where the rows to drop
    are too many to broadcast."""
    nodes = _classes(docs, id_col, text_col, k, percent, bands, rows).select("text", "root")
    own = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text")).groupBy("id", "text").agg(F.count("*").alias("copies"))
    own = stored(own.join(nodes, "text", "left").where("root IS NOT NULL OR id IS NOT NULL").withColumn("alone", F.when(F.col("root").isNull(), F.col("id"))), "own")
    best = own.groupBy("root", "alone").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("best"))
    best = best.withColumnsRenamed({"root": "root2", "alone": "alone2"})
    gone = stored(own.join(best, own["root"].eqNullSafe(best["root2"]) & own["alone"].eqNullSafe(best["alone2"]))
                  .withColumn("first", (F.col("text") == F.col("best.text")) & F.col("id").eqNullSafe(F.col("best.id")))
                  .where("NOT first OR copies > 1").select(F.col("id").alias("__nd_id"), F.col("text").alias("__nd_text2"), "first"), "gone")
    again = gone.where("first")

    def met(other: DataFrame, how: str) -> DataFrame:
        other = other.drop("first")
        other = F.broadcast(other) if other.count() <= SMALL_ROWS else other
        return docs.join(other, docs[id_col].eqNullSafe(other["__nd_id"]) & (digest(docs[text_col]) == other["__nd_text2"]), how)

    one = met(again, "inner").dropDuplicates(["__nd_id", "__nd_text2"]).drop("__nd_id", "__nd_text2")
    return met(gone, "left_anti").unionByName(one)


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(text, n, first_id, root) of each distinct text with words; root names its class."""
    sig = stored(signatures(docs, id_col, text_col, k, bands, rows), "signatures")
    root = _components(docs, sig, id_col, text_col, k, percent)
    return sig.select("text", "n", "first_id").join(root, "text", "left").withColumn("root", F.coalesce("root", "text"))


def _components(docs: DataFrame, sig: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(text, root) for the nodes that are linked with another."""
    spread = sig.select("text", "n", F.explode_outer("bands").alias("bucket"))
    shared = stored(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = stored(may_match(spread, shared, "bucket").join(shared, "bucket"), "buckets")
    near = stored(members.groupBy("text").agg(F.sum("size").alias("near")), "nodes")
    sets = _sets(docs, sig, near, id_col, text_col, k)
    members = members.select("bucket", "text", "n", F.lit(0).alias("side"))
    root = near.select("text", F.col("text").alias("root"))
    now = members.withColumn("root", F.col("text"))  # each is a component of its own: all buckets are mixed
    if is_empty(now):
        return root
    hubs = _hubs(now, near, 1)
    root, _ = _star_turn(now, hubs, root, sets, percent)
    left = _mixed(members, root).join(hubs.select("bucket", F.col("text2").alias("hub")), "bucket").where("text != hub")
    members = stored(_difference_members(left.select("hub", "text", "n").distinct(), sets, percent), "differences")
    while True:
        now = _mixed(members, root)
        if is_empty(now):
            return root
        root, members = _star_turn(now, _hubs(now, near, HUBS), root, sets, percent)


def _mixed(members: DataFrame, root: DataFrame) -> DataFrame:
    """(bucket, text, n, side, root, major) of the buckets whose nodes lie in several components and, where a
    bucket has two sides, on both; ``major`` is the component that most of them lie in."""
    now = members.join(root, "text")
    size = now.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.min("side").alias("low"), F.max("side").alias("high"))
    mixed = size.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots"), F.min("low").alias("low"), F.max("high").alias("high"))
    mixed = mixed.where("roots > 1 AND (low = 0 OR low != high)")
    return stored(now.join(mixed.select("bucket", F.col("most.root").alias("major")), "bucket"), "mixed")


def _hubs(now: DataFrame, near: DataFrame, hubs: int) -> DataFrame:
    """(bucket, text2, n2, side2, root2): ``hubs`` nodes of each bucket. A single one is the node with most neighbours in
    all its buckets, the likeliest to be linked with the others; several are first of all those outside
    the bucket's major component, as a bucket is done when no others are left."""
    ranked = now.join(near, "text")
    order = F.struct((-F.col("near")).alias("far"), F.xxhash64("text").alias("h"), F.col("text").alias("text2"), F.col("n").alias("n2"), F.col("side").alias("side2"), F.col("root").alias("root2"))
    if hubs == 1:
        star = ranked.groupBy("bucket").agg(F.min(order).alias("x"))
    else:
        first = Window.partitionBy("bucket").orderBy(F.col("root") == F.col("major"), "x")
        star = ranked.select("bucket", "root", "major", order.alias("x")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= hubs)
    return stored(star.select("bucket", "x.text2", "x.n2", "x.side2", "x.root2"), "hubs")


def _star_turn(now: DataFrame, hubs: DataFrame, root: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The new roots once every node has been compared with the hubs of its buckets, and the members without
    those: all pairs that hold one are done, so the work grows with the members."""
    met = now.join(hubs, "bucket").where("root != root2 AND side + side2 = 0")
    pairs = stored(_near_in_size(met, percent), "pairs")
    if not is_empty(pairs):
        root = _merged(root, _confirmed(pairs, sets, percent))
    rest = now.join(hubs.select("bucket", F.col("text2").alias("text")), ["bucket", "text"], "left_anti")
    return root, rest.select("bucket", "text", "n", "side")


def _near_in_size(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")).select("text", "root", "text2", "root2").distinct()


def _merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """(text, root) once the components that ``links`` join are one."""
    merged = connected_components(links.select(F.col("root").alias("a"), F.col("root2").alias("b")), "classes")
    return stored(root.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
                  .select("text", F.coalesce("to", "root").alias("root")), "roots")


def _size_class(d: Column) -> Column:
    """Sizes of a class differ by a factor of less than 1 + ``CLASS_WIDTH``."""
    return F.floor(F.log1p(d.cast("double")) / F.lit(math.log1p(CLASS_WIDTH)) + F.lit(1e-9)).cast("int")


def _difference_members(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, text, n, side): the (hub, text, n) of ``nodes`` in buckets such that every pair of a hub's nodes that may be
    linked, and isn't in one component through the hub, shares one; few others do.

    Let D be what a node's set and its hub's don't share. Two sets x, y are linked only if they differ in up
    to H = (100 - percent) / (100 + percent) * (n_x + n_y) shingles, and they differ in |Dx| + |Dy| - 2 |Dx and
    Dy|. If |Dx| + |Dy| <= H, both are linked with the hub, which has been compared with all its nodes. Else
    Dx and Dy share at least c = (|Dx| + |Dy| - H) / 2 shingles, so the |Dx| - c + 1 rarest of the one and
    the |Dy| - c + 1 rarest of the other have one in common. A bucket is a hub, such a shingle and the classes of
    the two sizes |D|; ``side`` tells the smaller (-1) from the larger (1), or is 0 where the classes are one.
    Shingles that only one node of a hub has in D are left out, but take their places among the
    rarest: nodes that differ from the hub each in its own way have no bucket at all. Nor are buckets
    returned that have only one node or one of two sides."""
    nodes = stored(nodes, "apart")
    own = may_match(sets, nodes, "text").withColumnRenamed("s", "s1")
    other = may_match(sets, nodes.select(F.col("hub").alias("text")), "text").select(F.col("text").alias("hub"), F.col("s").alias("s2"))
    each = nodes.join(own, "text").join(other, "hub").select("hub", "text", "n", F.concat(F.array_except("s1", "s2"), F.array_except("s2", "s1")).alias("d"))
    each = stored(each, "unshared").select("hub", "text", "n", F.size("d").alias("size"), F.explode_outer("d").alias("s"))
    often = each.groupBy("hub", "s").agg(F.count("*").alias("often")).where("often > 1")
    ranked = each.join(often, ["hub", "s"]).groupBy("hub", "text", "n", "size").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("shared"))
    widest = F.col("n") * (1 + 100 / percent) * ((100 - percent) / (100 + percent)) + 1e-6  # H for the largest partner
    low, high = F.greatest(F.lit(0.0), F.ceil(F.col("size") - widest)), F.floor(F.col("size") + widest)
    ranked = ranked.select("hub", "text", "n", "size", F.transform("shared", lambda x: x["s"]).alias("shared"), (F.col("size") - F.size("shared")).alias("alone"),
                           _size_class(F.col("size")).alias("own"), low.alias("low"), widest.alias("widest"), F.explode(F.sequence(_size_class(low), _size_class(high))).alias("other"))
    least = F.greatest(F.col("low"), F.ceil(F.exp(F.col("other") * F.lit(math.log1p(CLASS_WIDTH))) - F.lit(1 + 1e-6)))
    common = F.greatest(F.lit(1), F.ceil((F.col("size") + least - F.col("widest")) / 2))
    prefix = ranked.withColumn("take", F.least(F.size("shared"), (F.col("size") - common + 1 - F.col("alone")).cast("int"))).where("take > 0")
    prefix = prefix.select("hub", "text", "n", "own", "other", F.explode(F.expr("slice(shared, 1, take)")).alias("s"))
    members = stored(prefix.select(F.xxhash64("hub", "s", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "text", "n",
                                   F.signum(F.col("own") - F.col("other")).cast("int").alias("side")), "prefixes")
    paired = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("side").alias("low"), F.max("side").alias("high"))
    paired = stored(paired.where("size > 1 AND (low = 0 OR low != high)").select("bucket"), "paired")
    return may_match(members, paired, "bucket").join(paired, "bucket", "left_semi")


def _sets(docs: DataFrame, sig: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(text, s): the shingle set of each node that shares a bucket, from a row that has the text: of
    copies only those with the smallest id are shuffled."""
    need = stored(members.select("text").distinct().join(sig.select("text", F.col("first_id").alias("id")), "text"), "need")
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text"), F.col(text_col).alias("body"))
    rows = may_match(rows, need, "id", "text").groupBy("text").agg(F.any_value("body").alias("body")).join(need, "text", "left_semi")
    return stored(rows.select("text", word_list(F.col("body")).alias("w")).select("text", shingle_set("w", k).alias("s")), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (stored) pairs whose full sets are similar enough."""
    first, second = may_match(sets, pairs, "text"), may_match(sets, pairs.select(F.col("text2").alias("text")), "text")
    both = (pairs.join(first.withColumnRenamed("s", "s1"), "text")
            .join(second.select(F.col("text").alias("text2"), F.col("s").alias("s2")), "text2")
            .withColumn("both", F.size(F.array_intersect("s1", "s2"))))
    return both.where(100 * F.col("both") >= percent * (F.size("s1") + F.size("s2") - F.col("both"))).select("root", "root2").distinct()


def op5_minhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), x0 AS (
  SELECT doc_id, array_to_string(ws, chr(10)) AS g FROM d WHERE len(ws) BETWEEN 1 AND 4
  UNION ALL
  SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) >= 5) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), x1 AS (SELECT DISTINCT doc_id, g FROM x0 WHERE g IS NOT NULL),
s AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN x1 USING (doc_id) GROUP BY d.doc_id),
x AS (SELECT doc_id, n, g FROM x1 JOIN s USING (doc_id)),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), c AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT s.doc_id, n AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.u = s.doc_id
"""
