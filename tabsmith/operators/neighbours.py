"""Exact nearest neighbours inside groups (for P07), without comparing all pairs.

The points of a group are dealt to cells around pivots, cells to units of bounded size. A point meets
its own unit first, which bounds the distance of its k-th neighbour; another unit is visited only
if the triangle inequality lets it hold something nearer: distance to its pivot less its radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage

#: Points of a cell on average, pivots of a group at most, points of a unit and of a block of visits.
CELL, PIVOTS, UNIT, VISITS = 512, 4096, 2048, 4096
#: Cells of a distance table that one step of a task holds.
TABLE = 1 << 20
#: Relative slack of the bounds, far above rounding and far below any use.
SLACK = 1e-9

NEAR = "array<struct<dist double, node long>>"


def _cogrouped(left: DataFrame, right: DataFrame, key: list[str], of, schema: str) -> DataFrame:
    """``of`` applied to the rows of both sides by ``key``; the right side's columns are named anew, as both may
    come from one table."""
    right = right.select(*(F.col(c).alias(f"__{c}") for c in right.columns)).toDF(*right.columns)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(of, schema)


def _points(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all ``a`` to all ``b``, summed feature by feature: equal points are at 0 and the
    sums are those of plain SQL."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return np.sqrt(total)


def _nearest(grp: str, node: np.ndarray, x: np.ndarray, to_node: np.ndarray, to: np.ndarray, k: int) -> pa.Table:
    """(grp, node, near) with the ``k`` nearest of ``to`` for each point, itself left out."""
    near = []
    step = max(1, TABLE // max(1, len(to)))
    by_node = np.argsort(to_node, kind="stable")
    to_node, to = to_node[by_node], to[by_node]  # a stable sort by distance then breaks ties by node
    for at in range(0, len(x), step):
        d = distances(x[at:at + step], to)
        d[node[at:at + step, None] == to_node[None, :]] = np.inf
        m = min(k, d.shape[1])
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        for row, limit in zip(d, edge):
            some = np.flatnonzero(row <= limit)
            some = some[np.argsort(row[some], kind="stable")][:m]
            near.append([{"dist": float(row[i]), "node": int(to_node[i])} for i in some if np.isfinite(row[i])])
    return pa.table({"grp": pa.array([grp] * len(x), pa.string()), "node": pa.array(node, pa.int64()),
                     "near": pa.array(near, pa.list_(pa.struct([("dist", pa.float64()), ("node", pa.int64())])))})


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of all lists of a point."""
    return found.groupBy("grp", "node").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def _units(points: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, cell, part, node, x, dist), each point at its nearest pivot, and (grp, cell, p). Pivots are a group's first nodes, a
    cell's points are dealt by number to parts of at most ``UNIT``."""
    pivots = points.join(sizes, "grp").withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("size") / CELL)))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("node"))
    pivots = pivots.withColumn("r", rank).where(F.col("r") <= PIVOTS).where(F.col("r") <= F.col("pivots")).select("grp", F.col("r").cast("long").alias("cell"), F.col("x").alias("p"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("size") / F.lit(16 * UNIT)).cast("int"))
    left = points.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("grp", "block", "node", "x")
    right = pivots.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "block", "cell", "p")

    def deal(points: pa.Table, pivots: pa.Table) -> pa.Table:
        if not points.num_rows:
            return pa.table({"grp": pa.array([], pa.string()), "cell": pa.array([], pa.int64()), "node": pa.array([], pa.int64()),
                             "x": pa.array([], pa.list_(pa.float64())), "dist": pa.array([], pa.float64())})
        x, p, cell = _points(points["x"]), _points(pivots["p"]), pivots["cell"].to_numpy()
        best, dist = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        step = max(1, TABLE // len(p))
        for at in range(0, len(x), step):
            d = distances(x[at:at + step], p)
            best[at:at + step] = d.argmin(1)
            dist[at:at + step] = d.min(1)
        return pa.table({"grp": points["grp"], "cell": pa.array(cell[best].astype(np.int64)), "node": points["node"], "x": points["x"], "dist": pa.array(dist)})

    dealt = _cogrouped(left, right, ["grp", "block"], deal, "grp string, cell long, node long, x array<double>, dist double")
    dealt = cut_lineage(dealt)
    parts = dealt.groupBy("grp", "cell").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts"))
    return dealt.join(parts, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"), pivots


def nearest_in_group(points: DataFrame, k: int = 5) -> DataFrame:
    """(grp, node, near): the ``k`` nearest other nodes of the same group, nearest first, ties by node, fewer
    where the group is smaller. ``points`` has grp (string, not null), node (long, unique in its group)
    and x (array of doubles, finite, of one length); equal points should be one node.

    Exact: a unit is left out only where it can't hold a nearer point. Groups of any size are spread over
    units of ``UNIT``; what a task holds is one unit and ``VISITS`` points. The work that is saved
    depends on the data: far fewer units than there are for few or dependent features, most of them
    for many independent ones."""
    points = cut_lineage(points.select("grp", "node", "x"))
    sizes = points.groupBy("grp").agg(F.count("*").alias("size"))
    units, pivots = _units(points, sizes)
    units = cut_lineage(units)

    def own(table: pa.Table) -> pa.Table:
        node, x = table["node"].to_numpy(), _points(table["x"])
        return _nearest(table["grp"][0].as_py(), node, x, node, x, k)

    first = units.groupBy("grp", "cell", "part").applyInArrow(own, f"grp string, node long, near {NEAR}")
    bound = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["dist"])  # null: any distance may do
    first = cut_lineage(units.join(first, ["grp", "node"]).withColumn("bound", bound))
    places = units.groupBy("grp", "cell", "part").agg(F.max("dist").alias("radius")).join(pivots, ["grp", "cell"])
    reach = first.groupBy("grp", "cell", "part").agg(F.max(F.coalesce("bound", F.lit(float("inf")))).alias("reach"))
    places = cut_lineage(places.join(reach, ["grp", "cell", "part"]))
    asked = _unit_pairs(places).join(first.select("grp", "cell", "part", "node", "x", "bound"), ["grp", "cell", "part"])
    to_pivot = F.sqrt(F.aggregate(F.zip_with("x", "p2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    asked = asked.where(F.col("bound").isNull() | (to_pivot - F.col("radius2") <= F.col("bound") * (1 + SLACK) + SLACK))
    asked = cut_lineage(asked.select("grp", F.col("cell2").alias("cell"), F.col("part2").alias("part"), "node", "x"))
    blocks = asked.groupBy("grp", "cell", "part").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("blocks"))
    left = asked.join(blocks, ["grp", "cell", "part"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    right = units.join(blocks, ["grp", "cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "dist")

    def visit(queries: pa.Table, unit: pa.Table) -> pa.Table:
        return _nearest(queries["grp"][0].as_py(), queries["node"].to_numpy(), _points(queries["x"]), unit["node"].to_numpy(), _points(unit["x"]), k)

    more = _cogrouped(left, right, ["grp", "cell", "part", "block"], visit, f"grp string, node long, near {NEAR}")
    return _merge(first.select("grp", "node", "near").unionByName(more), k)


def _unit_pairs(places: DataFrame) -> DataFrame:
    """(grp, cell, part, cell2, part2, p2, radius2): for each unit the others of its group that some of its points
    may have to visit. Units are compared by pivot, radius and reach alone, in blocks."""
    counts = places.groupBy("grp").agg(F.ceil(F.count("*") / 1024).cast("int").alias("blocks"))
    spread = places.join(counts, "grp")
    block = F.pmod(F.xxhash64("cell", "part"), F.col("blocks")).cast("int")
    left = spread.withColumn("a", block).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = spread.withColumn("b", block).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def pairs(mine: pa.Table, others: pa.Table) -> pa.Table:
        kinds = pa.schema([("grp", pa.string()), ("cell", pa.int64()), ("part", pa.int32()), ("cell2", pa.int64()), ("part2", pa.int32()), ("p2", pa.list_(pa.float64())), ("radius2", pa.float64())])
        if not mine.num_rows or not others.num_rows:
            return kinds.empty_table()
        d = distances(_points(mine["p"]), _points(others["p"]))
        least = d - mine["radius"].to_numpy()[:, None] - others["radius"].to_numpy()[None, :]
        reach = mine["reach"].to_numpy()[:, None]
        ok = least <= reach * (1 + SLACK) + SLACK
        ok &= (mine["cell"].to_numpy()[:, None] != others["cell"].to_numpy()[None, :]) | (mine["part"].to_numpy()[:, None] != others["part"].to_numpy()[None, :])
        i, j = (pa.array(v) for v in np.nonzero(ok))
        return pa.Table.from_arrays([mine["grp"].take(i), mine["cell"].take(i), mine["part"].take(i), others["cell"].take(j), others["part"].take(j),
                                     others["p"].take(j), others["radius"].take(j)], schema=kinds)

    columns = ["grp", "a", "b", "cell", "part", "p", "radius", "reach"]
    return _cogrouped(left.select(*columns), right.select(*columns), ["grp", "a", "b"], pairs,
                      "grp string, cell long, part int, cell2 long, part2 int, p2 array<double>, radius2 double")
