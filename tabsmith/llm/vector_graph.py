"""Near-duplicates among embeddings by a robust-pruned flat graph.

Vectors are dealt to overlapping shards, each to its nearest cluster centres; every shard gets a
graph whose edges are pruned so that they point in different directions; a vector's adjacency
lists from its shards are united. Each vector is then searched for in its nearest shard and what
the united lists lead to: greedily from the shard's medoids, and further as long as vectors
inside the range turn up; where these are at home in other shards, it is searched for there too.
Links are confirmed in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm import common
from tabsmith.llm.common import connected_components, is_empty
from tabsmith.session import shuffle_files_removed

#: Vectors of a shard; vectors that a shard's centres are fitted on; centres of a level at most; shards
#: that a vector is in at each level.
SHARD, SAMPLE, CENTRES, OVERLAP = 1500, 8192, 256, 3
#: Vectors that a task deals to centres at a time.
BLOCK = 8192
#: Candidates and edges of a vector in a shard, detour that pruning allows, steps of a search at least.
NEAR, DEGREE, ALPHA, EFFORT = 64, 24, 1.2, 24
#: How far below the threshold a vector may be for the search to go on from it.
SLACK = 0.04
#: Visits that a task searches for in a shard at a time, and vectors in range that a visit starts from.
VISITS, STARTS = 4096, 8


def stored(df: DataFrame, name: str) -> DataFrame:
    """``common.stored``; what was shuffled for the table goes as soon as it's written."""
    with shuffle_files_removed(df.sparkSession):
        return common.stored(df, name)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _units(table: pa.Table) -> np.ndarray:
    """Unit vectors in double precision."""
    return _matrix(table["v"]).astype(np.float64) / table["norm"].to_numpy()[:, None]


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (nid, key, first, copies, v, norm) and (id, key) of all rows. Vectors of floats
    stay floats wherever they are stored or shuffled; unit vectors are made in double precision when read.
    Vectors that are null, empty, zero or hold null or non-finite components have no class."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("given"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    fine = F.size("v") > 0
    fine = fine & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("norm", F.when(fine, norm)).withColumn("norm", F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("norm")))
    rows = rows.withColumn("key", F.when(F.col("norm").isNotNull(), F.unhex(F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))))
    classes = (rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("given").alias("v"), F.min("norm").alias("norm")))
    classes = stored(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    return classes, rows.select("id", "key")


def _centres(table: pa.Table) -> pa.Table:
    """Centres of one shard's sample by spherical k-means."""
    x, k = _units(table), table["k"][0].as_py()
    rng = np.random.default_rng(len(x))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.string()), "centres": pa.array([c.tolist()], pa.list_(pa.list_(pa.float64())))})


def _dealt(vectors: pa.Table, centres: pa.Table) -> pa.Table:
    """One block of a shard's vectors, each to its nearest centres; rank 0 is the nearest one all the
    way down. Only a vector at rank 0 goes to several, so that a vector is in 1 + (OVERLAP - 1) * levels
    shards at most, however often a dense group must be split."""
    shard, c = centres["shard"][0].as_py(), np.array(centres["centres"][0].as_py())
    x, rank = _units(vectors), vectors["rank"].to_numpy()
    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP]
    row, place = np.nonzero((rank == 0)[:, None] | (np.arange(near.shape[1]) == 0)[None, :])
    return pa.table({"shard": pa.array([f"{shard}.{j}" for j in near[row, place]], pa.string()), "nid": vectors["nid"].take(pa.array(row)),
                     "v": vectors["v"].take(pa.array(row)), "norm": vectors["norm"].take(pa.array(row)), "rank": pa.array(np.maximum(rank[row], place).astype(np.int32))})


def overlapping_shards(classes: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(shard, nid, v, norm, rank). Shards larger than ``shard`` are split level by level, up to
    ``CENTRES`` ways each, by centres fitted on ``sample`` of their vectors with the smallest hashes.
    Vectors of different length never share a shard."""
    now = classes.select(F.size("v").cast("string").alias("shard"), "nid", "v", "norm", F.lit(0).alias("rank"))
    given = now.schema["v"].dataType.simpleString()
    for _ in range(6):
        large = now.groupBy("shard").agg(F.count("*").alias("count"), F.count_if(F.col("rank") == 0).alias("home")).where(F.col("count") > shard)
        dealt = F.col("count") + F.col("home") * (OVERLAP - 1)
        large = stored(large.select("shard", F.greatest(F.least(F.ceil(dealt / shard), F.lit(CENTRES)), F.lit(2)).cast("int").alias("k"),
                                    F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
        if not large.take(1):
            break
        order = Window.partitionBy("shard").orderBy(F.xxhash64("nid"), "nid")
        part = now.select("shard", "nid").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).drop("r").join(large, "shard")
        fitted = part.join(classes.select("nid", "v", "norm"), "nid").select("shard", "k", "v", "norm").groupBy("shard").applyInArrow(_centres, "shard string, centres array<array<double>>")
        fitted = stored(fitted, "centres").join(large, "shard").select("shard", "centres", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        blocks = now.join(large, "shard").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
        split = blocks.groupBy("shard", "block").cogroup(fitted.groupBy("shard", "block")).applyInArrow(_dealt, f"shard string, nid long, v {given}, norm double, rank int")
        now = stored(now.join(large, "shard", "left_anti").select("shard", "nid", "v", "norm", "rank").unionByName(split), "shards")
    return now


def robust_prune(x: np.ndarray, degree: int = DEGREE, near: int = NEAR, alpha: float = ALPHA, seed: int = 1) -> np.ndarray:
    """Adjacency (rows, degree) of local numbers, -1 where there are fewer. Of each vector's nearest
    candidates and some at random, the nearest is taken and those go that are nearer to it, by
    ``alpha``, than to the vector; and so on. Distances are squared Euclidean."""
    n = len(x)
    out = np.full((n, degree), -1, dtype=np.int64)
    if n < 2:
        return out
    rng = np.random.default_rng(seed)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -np.inf
        m = min(near, n - 1)
        cand = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        cand = np.concatenate([cand, rng.integers(0, n, (len(rows), 16))], axis=1)
        dist = 2 - 2 * np.take_along_axis(sim, cand, axis=1)
        dist[cand == rows[:, None]] = np.inf
        alive = np.isfinite(dist)
        for d in range(degree):
            best = np.where(alive, dist, np.inf).argmin(1)
            some = alive[np.arange(len(rows)), best]
            if not some.any():
                break
            pick = cand[np.arange(len(rows)), best]
            out[rows[some], d] = pick[some]
            between = 2 - 2 * np.einsum("nd,nkd->nk", x[pick], x[cand])
            alive &= (alpha * between > dist) & (cand != pick[:, None])
            alive[~some] = False
    return out


def _graph(table: pa.Table) -> pa.Table:
    """Adjacency lists of one shard by global number, with edges added the other way round."""
    nid, x = table["nid"].to_numpy(), _units(table)
    adjacent = robust_prune(x)
    lists = [set(r[r >= 0].tolist()) for r in adjacent]
    for i, r in enumerate(adjacent):
        for j in r[r >= 0]:
            if len(lists[j]) < 2 * DEGREE:
                lists[j].add(i)
    return pa.table({"nid": pa.array(nid, pa.int64()), "next": pa.array([sorted(nid[list(s)].tolist()) for s in lists], pa.list_(pa.int64()))})


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, code) of vectors: a scale and the length of what rounding takes off, as floats, and each component in
    a byte, in units of the scale."""
    for batch in batches:
        sizes = pc.list_value_length(batch["v"])
        for size in pc.unique(sizes):
            part = pa.table(batch).filter(pc.equal(sizes, size)).combine_chunks()
            x = _units(part)
            scale = (np.abs(x).max(1) / 127).astype(np.float32)
            small = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
            off = np.linalg.norm(x - small * scale[:, None].astype(np.float64), axis=1)
            head = np.stack([scale, np.nextafter(off.astype(np.float32), np.float32(np.inf))], axis=1)
            code = np.concatenate([head.view(np.uint8), small.view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([part["nid"].combine_chunks(), pa.array([r.tobytes() for r in code], pa.binary())], ["nid", "code"])


def _near_home(home: pa.Table, border: pa.Table, least: float, block: int = 2048) -> pa.Table:
    """Of a shard's border (shard, nid, code), those that may have a cosine of ``least`` with a vector at home."""
    kept = np.zeros(border.num_rows, dtype=bool)
    if home.num_rows and border.num_rows:
        x = _units(home)
        code = np.frombuffer(b"".join(border["code"].to_pylist()), dtype=np.uint8).reshape(border.num_rows, -1)
        head = np.ascontiguousarray(code[:, :8]).view(np.float32).astype(np.float64)
        for at in range(0, border.num_rows, block):
            rows = slice(at, at + block)
            y = np.ascontiguousarray(code[rows, 8:]).view(np.int8) * head[rows, :1]
            for k in range(0, len(x), block):
                kept[rows] |= (y @ x[k:k + block].T).max(1) + head[rows, 1] >= least - 1e-6
    return border.select(["shard", "nid"]).filter(pa.array(kept))


def bordering(pairs: DataFrame, shards: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (shard, nid), those whose vector may be in range of one that visits the shard.

    Who visits a shard is in range of a vector at home there (at first, of itself). So what both are in range of
    has at most twice the angle of the range to that vector. The rest would be met by searches in vain, and nothing
    is adjacent to it there. Codes of a byte a component are compared, with what rounding took off added: none that
    is in range is left out, and only vectors that stay are sent in full."""
    least = 2 * threshold ** 2 - 1 if threshold > 0 else -1.0
    codes = classes.select("nid", "v", "norm").mapInArrow(_codes, "nid long, code binary")
    home = shards.where("rank = 0").select("shard", "v", "norm")
    return (home.groupBy("shard").cogroup(pairs.join(codes, "nid").select("shard", "nid", "code").groupBy("shard"))
            .applyInArrow(lambda left, right: _near_home(left, right, least), "shard string, nid long"))


def range_search(x: np.ndarray, adjacent: np.ndarray, q: np.ndarray, medoids: np.ndarray, starts: tuple[np.ndarray, np.ndarray], threshold: float,
                 effort: int = EFFORT, slack: float = SLACK, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first query of the block, its rows of cosines to all of ``x``, -inf where not met) of a greedy search for
    ``q`` from the ``medoids`` and from ``starts`` (query, vector). For ``effort`` steps a search goes on from
    the best vector met that it hasn't gone on from; besides, and until none is left, from all
    vectors in range at once."""
    n, degree = len(x), adjacent.shape[1]
    for at in range(0, len(q), block):
        own = q[at:at + block]
        rows = np.arange(len(own))
        sim = np.full((len(own), n), -np.inf)
        sim[:, medoids] = own @ x[medoids].T
        here = (starts[0] >= at) & (starts[0] < at + block)
        r, c = starts[0][here] - at, starts[1][here]
        sim[r, c] = np.einsum("nd,nd->n", own[r], x[c])
        ahead = sim.copy()  # of the vectors met, those that the search hasn't gone on from
        step = 0
        while True:
            who, node = np.nonzero(ahead >= threshold - slack)
            if step < effort:
                best = ahead.argmax(1)
                more = np.isfinite(ahead[rows, best]) & (ahead[rows, best] < threshold - slack)
                who, node = np.concatenate([who, rows[more]]), np.concatenate([node, best[more]])
            if not len(who):
                break
            ahead[who, node] = -np.inf
            for k in range(0, len(who), 50_000):
                near = adjacent[node[k:k + 50_000]]
                place = (np.repeat(who[k:k + 50_000], degree) * n + near.reshape(-1))[near.reshape(-1) >= 0]
                place = np.unique(place[~np.isfinite(sim.reshape(-1)[place])])
                r, c = np.divmod(place, n)
                sim[r, c] = ahead[r, c] = np.einsum("nd,nd->n", own[r], x[c])
            step += 1
        yield at, sim


def spanning(linked: np.ndarray, query: np.ndarray, nid: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(numbers, smallest number) of the components of the graph whose edges are the true entries of
    ``linked`` (query, vector); a query may be one of the vectors."""
    place = {n: i for i, n in enumerate(nid.tolist())}
    as_vector = np.array([place.get(n, -1) for n in query.tolist()], dtype=np.int64)
    as_query = np.full(len(nid), -1, dtype=np.int64)
    as_query[as_vector[as_vector >= 0]] = np.flatnonzero(as_vector >= 0)
    open_ = linked.any(1)
    for first in np.flatnonzero(open_):
        if not open_[first]:
            continue
        queries, vectors = np.zeros(len(query), dtype=bool), np.zeros(len(nid), dtype=bool)
        new = np.array([first])
        while len(new):
            queries[new] = True
            reached = linked[new].any(0)
            reached[as_vector[new][as_vector[new] >= 0]] = True
            reached &= ~vectors
            vectors |= reached
            also = as_query[reached]
            hit = linked[:, reached].any(1)
            hit[also[also >= 0]] = True
            new = np.flatnonzero(hit & ~queries)
        open_ &= ~queries
        numbers = np.unique(np.concatenate([query[queries], nid[vectors]]))
        yield numbers, int(numbers[0])


FOUND = "q long, n long, home string, start long, node long, root long"


def _search(nodes: pa.Table, visits: pa.Table, threshold: float) -> pa.Table:
    """What a block of visits finds in a shard, as rows of three kinds: (q, n) counts the vectors in range whose
    home is this shard; (q, home, start) names another shard in which some in range are at home, that
    the visit doesn't know yet, and the nearest of them; (node, root) are components of what is linked."""
    kinds = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("home", pa.string()), ("start", pa.int64()), ("node", pa.int64()), ("root", pa.int64())])
    if not nodes.num_rows or not visits.num_rows:
        return kinds.empty_table()
    parts = []

    def add(**columns):
        n = len(next(iter(columns.values())))
        parts.append(pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds))

    nid, x, rank = nodes["nid"].to_numpy(), _units(nodes), nodes["rank"].to_numpy()
    homes = nodes["home"].combine_chunks().dictionary_encode()
    names, home, copies = homes.dictionary, homes.indices.to_numpy(), nodes["copies"].to_numpy()
    number = {n: i for i, n in enumerate(names.to_pylist())}
    here = number[nodes["shard"][0].as_py()]
    place = {n: i for i, n in enumerate(nid.tolist())}
    lists = [[place[n] for n in own if n in place] for own in nodes["next"].to_pylist()]
    adjacent = np.full((len(nid), max(1, max(map(len, lists)))), -1, dtype=np.int64)
    for i, own in enumerate(lists):
        adjacent[i, :len(own)] = own
    inside = np.flatnonzero(rank >= 0)
    medoids = [inside[(x[inside] @ x[inside].mean(0)).argmax()]]
    far = x[inside] @ x[medoids[0]]
    for _ in range(min(7, len(inside) - 1)):  # the medoid and, one after another, the members farthest from those before
        medoids.append(inside[far.argmin()])
        far = np.maximum(far, x[inside] @ x[medoids[-1]])
    query, q = visits["nid"].to_numpy(), _units(visits)
    given = [(i, place[n]) for i, own in enumerate(visits["starts"].to_pylist()) for n in own if n in place]
    starts = (np.array([g[0] for g in given], dtype=np.int64), np.array([g[1] for g in given], dtype=np.int64))
    new = np.ones((len(query), len(names)), dtype=bool)
    new[:, here] = False
    for i, own in enumerate(visits["known"].to_pylist()):
        new[i, [number[h] for h in own if h in number]] = False
    by_home = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[by_home], np.arange(len(names)))
    linked = np.zeros((len(query), len(nid)), dtype=bool)
    for at, sim in range_search(x, adjacent, q, np.unique(medoids), starts, threshold):
        close = sim >= threshold
        close &= query[at:at + len(sim), None] != nid[None, :]
        linked[at:at + len(sim)] = close
        counts = close @ np.where(home == here, copies, 0)
        some = np.flatnonzero(counts)
        add(q=query[at + some], n=counts[some])
        sim[~close] = -np.inf
        who, to = np.nonzero(np.isfinite(np.maximum.reduceat(sim[:, by_home], bounds, axis=1)) & new[at:at + len(sim)])
        if len(who):
            nearest = np.array([bounds[h] + sim[i, by_home[bounds[h]:bounds[h + 1] if h + 1 < len(bounds) else None]].argmax() for i, h in zip(who, to, strict=True)])
            add(q=query[at + who], home=names.take(pa.array(to)), start=nid[by_home[nearest]])
    for numbers, root in spanning(linked, query, nid):
        add(node=numbers, root=np.full(len(numbers), root))
    return pa.concat_tables(parts).combine_chunks() if parts else kinds.empty_table()


def vector_links(classes: DataFrame, shards: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(nid, linked) and (a, b): how many vectors (copies counted) each class was found in range of, and links
    that span the components.

    A class is at home in one shard. It visits its home first, then every shard in which it has met
    vectors in range at home, until no visit finds a new one: a group that lies in many shards is
    followed through all of them. A visit counts the shard's own vectors only, so none counts twice,
    and no list of pairs is made. A shard's nodes are its members and, of what these are adjacent to elsewhere, the
    vectors that may be in range of a visit (``bordering``)."""
    graph = shards.groupBy("shard").applyInArrow(_graph, "nid long, next array<long>")
    united = graph.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    known = stored(united.join(shards.where("rank = 0").select("nid", F.col("shard").alias("home")), "nid").join(classes.select("nid", "copies"), "nid"), "graph")
    members = shards.select("shard", "nid", "v", "norm", "rank").join(known, "nid")
    pairs = (known.select(F.col("home").alias("shard"), F.explode("next").alias("nid")).distinct()
             .join(shards.select("shard", "nid"), ["shard", "nid"], "left_anti"))
    border = (bordering(pairs, shards, classes, threshold).join(classes.select("nid", "v", "norm"), "nid").join(known.drop("next"), "nid")
              .select("nid", "shard", "v", "norm", F.lit(-1).alias("rank"), F.array().cast("array<long>").alias("next"), "home", "copies"))
    nodes = stored(members.select("shard", "nid", "v", "norm", "rank", "next", "home", "copies").unionByName(border), "nodes")
    visits = known.select("nid", F.col("home").alias("shard"), F.array().cast("array<long>").alias("starts"), F.array("home").alias("known"))
    done, counted, joined = None, None, None
    while True:
        # a row for each shard: broadcast, so that nodes and visits are dealt once, by shard and block
        sizes = F.broadcast(visits.groupBy("shard").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("blocks")))
        asked = (visits.join(sizes, "shard").join(classes.select("nid", "v", "norm"), "nid")
                 .select("shard", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block"), "nid", "v", "norm", "starts", "known"))
        dealt = nodes.join(sizes, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        found = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(lambda left, right: _search(left, right, threshold), FOUND)
        found = stored(found, "found")
        counts, edges = found.where("n IS NOT NULL").select("q", "n"), found.where("root IS NOT NULL AND node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        counted, joined = (counts, edges) if counted is None else (counted.unionByName(counts), joined.unionByName(edges))
        seen = visits.select("nid", "shard")
        done = seen if done is None else done.unionByName(seen)
        new = found.where("home IS NOT NULL").groupBy(F.col("q").alias("nid"), F.col("home").alias("shard")).agg(F.slice(F.collect_set("start"), 1, STARTS).alias("starts"))
        new = new.join(done, ["nid", "shard"], "left_anti")
        places = new.select("nid", "shard").unionByName(done).groupBy("nid").agg(F.collect_set("shard").alias("known"))
        visits = stored(new.join(places, "nid"), "visits")
        if is_empty(visits):
            return counted.groupBy(F.col("q").alias("nid")).agg(F.sum("n").alias("linked")), joined


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 shard: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    ``n_links`` counts the other rows found with a cosine of at least ``threshold``; equal vectors
    are one class in the graph and count in full. ``component_id`` is the smallest id that links
    reach, ``kept`` says whether it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different length. Repeated rows are rows of their own with their id; a null id
    is never the smallest: a class without any id has a null component_id, and its rows are kept.
    An empty table gives no rows. Other columns are ignored.

    Scale: no task holds more than a shard, its neighbours and one block of searches. A large group
    costs a visit for each of its vectors and shards; numbers of links are summed, pairs never listed."""
    classes, rows = classes_of(vectors, id_col, vector_col)
    degree, links = vector_links(classes, overlapping_shards(classes, shard), threshold)
    root = connected_components(links, "vector-classes").withColumnRenamed("node", "nid")
    nodes = (classes.select("key", "nid", "first", "copies").join(degree, "nid", "left").join(root, "nid", "left")
             .withColumn("root", F.coalesce("root", "nid")))
    low = nodes.groupBy("root").agg(F.min("first").alias("component"))
    nodes = nodes.join(low, "root").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component", F.lit(True).alias("has"))
    out = rows.join(nodes, "key", "left")
    component = F.when(F.col("has"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (component.isNull() | F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 every: int = 50, block: int = 2048) -> tuple[int, int]:
    """(links found, links there are) of the rows whose id is divisible by ``every``: their exact
    numbers of links, from a comparison with all rows block by block, against ``n_links``."""
    asked = vectors.where(F.col(id_col) % every == 0).select(id_col, vector_col)
    true = {}
    parts = max(1, -(-asked.count() // block))
    for part in range(parts):
        rows = [r for r in asked.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).collect() if r[1] is not None and None not in r[1]]
        q = np.array([r[1] for r in rows], dtype=np.float64)
        if not len(q):
            continue
        with np.errstate(all="ignore"):
            q = q / np.linalg.norm(q, axis=1, keepdims=True)

        def counted(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(q), dtype=np.int64)
            for batch in batches:
                x = np.array([v for v in batch.column(0).to_pylist() if v is not None and None not in v and len(v) == q.shape[1]], dtype=np.float64)
                if len(x):
                    with np.errstate(all="ignore"):
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                        total += (q @ x.T >= threshold).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q)), pa.int64()), pa.array(total, pa.int64())], ["i", "n"])

        for r in vectors.select(vector_col).mapInArrow(counted, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            true[rows[r["i"]][0]] = max(0, r["n"] - 1)
    found = {r[0]: r[1] for r in result.where(F.col(id_col) % every == 0).select(id_col, "n_links").collect()}
    return sum(min(found.get(i, 0), n) for i, n in true.items()), sum(true.values())


def op4_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
