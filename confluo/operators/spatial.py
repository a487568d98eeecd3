"""Joins by distance: grid cells make them equi-joins with a residual predicate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .graph import connected_components
from .storage import written


def degrees_for(metres: float, latitude: float = 27.0) -> float:
    """Edge of a grid cell such that points within ``metres`` lie in the same or in neighbouring cells up to that latitude."""
    return metres / (111_194.0 * math.cos(math.radians(latitude)))


def radius_join(left: DataFrame, right: DataFrame, metres: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left (l_id, lat, lng) with those of right (r_id, lat, lng) within a distance: l_id, r_id, metres.

    Columns of right in ``carry`` come along.
    """
    d = degrees_for(metres)
    a = left.selectExpr("l_id", "lat as la", "lng as lo").where("la is not null and lo is not null").withColumn("cell", F.explode(geo.cells_around(F.col("la"), F.col("lo"), d)))
    b = right.selectExpr("r_id", "lat as rla", "lng as rlo", *carry).where("rla is not null and rlo is not null").withColumn("cell", geo.cell(F.col("rla"), F.col("rlo"), d))
    near = a.join(b, "cell").withColumn("metres", geo.haversine_m(F.col("la"), F.col("lo"), F.col("rla"), F.col("rlo")))
    return near.where(F.col("metres") <= metres).select("l_id", "r_id", "metres", *carry)


#: The cells of ``nearest_k`` are halved so many times at most: those for 2 km are then two metres wide.
HALVINGS = 10


def nearest_k(left: DataFrame, right: DataFrame, metres: float, k: int, tie: str = "r_id") -> DataFrame:
    """The k nearest rows of right within a distance, for each row of left; rows of its own id are none of them.

    Each left row looks for the finest cell around it that holds enough rows; all of them are nearer than the cell's diagonal,
    so the k nearest lie in the three by three cells of twice the edge. Where no cell does, these are as for ``radius_join``. Of
    rows at one point only the first by id are met, so the work does not follow all pairs within the distance.
    """
    place = "lat is not null and lng is not null and not isnan(lat) and not isnan(lng)"
    points = right.where(place).select("r_id", F.col("lat").alias("rla"), F.col("lng").alias("rlo"))
    # k rows and those that may have the left row's id: one number
    enough = k + (points.groupBy("r_id").count().agg(F.max("count")).first()[0] or 0)
    first = F.row_number().over(W.partitionBy("rla", "rlo").orderBy("r_id"))
    points = written(points.withColumn("_r", first).where(F.col("_r") <= enough).drop("_r"), "near-points")
    levels = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("level")  # 0 is the coarsest

    def cell(lat: str, lng: str) -> Column:
        return geo.cell(F.col(lat), F.col(lng), degrees_for(metres) / F.pow(F.lit(2.0), F.col("level")))

    grid = points.select("*", levels).withColumn("cell", cell("rla", "rlo"))
    full = grid.groupBy("level", "cell").agg(F.count("*").alias("n")).where(F.col("n") >= enough).drop("n")
    seekers = left.where(place).select("l_id", F.col("lat").alias("la"), F.col("lng").alias("lo"))
    spots = seekers.select("la", "lo").distinct()
    found = spots.select("*", levels).withColumn("cell", cell("la", "lo")).join(full.hint("merge"), ["level", "cell"]).groupBy("la", "lo").agg(F.max("level").alias("level"))
    level = F.greatest(F.coalesce("level", F.lit(0)) - 1, F.lit(0))
    chosen = seekers.join(found.hint("merge"), ["la", "lo"], "left").withColumn("level", level)
    asked = chosen.withColumn("cell", F.explode(geo.cells_around(F.col("la"), F.col("lo"), degrees_for(metres) / F.pow(F.lit(2.0), F.col("level")))))
    near = asked.join(grid.hint("merge"), ["level", "cell"]).where("l_id <> r_id").withColumn("metres", geo.haversine_m(F.col("la"), F.col("lo"), F.col("rla"), F.col("rlo")))
    order = W.partitionBy("l_id").orderBy("metres", tie)
    return near.where(F.col("metres") <= metres).select("l_id", "r_id", "metres").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def single_link(points: DataFrame, metres: float) -> DataFrame:
    """(id, component): points (id, lat, lng) that a chain of steps of at most that distance connects."""
    pairs = radius_join(points.withColumnRenamed("id", "l_id"), points.withColumnRenamed("id", "r_id"), metres).where("l_id < r_id")
    return connected_components(points.select("id"), pairs.selectExpr("l_id as a", "r_id as b"))


def split_by_prefix(groups: DataFrame, most: int = 4, prefix: int = 3) -> DataFrame:
    """(id, component): members (id, component, name) of groups larger than ``most`` stay together only by shared name heads."""
    sized = groups.withColumn("n", F.count("*").over(W.partitionBy("component")))
    large = sized.where(F.col("n") > most)
    heads = large.withColumn("head", F.substring("name", 1, prefix)).withColumn("first", F.min("id").over(W.partitionBy("component", "head")))
    linked = connected_components(large.select("id"), heads.where("id <> first and length(head) = %d" % prefix).selectExpr("first as a", "id as b"))
    return sized.where(F.col("n") <= most).select("id", "component").unionByName(linked)


def common_prefix(names: Column) -> Column:
    """The longest common beginning of an array of strings."""
    shorter = F.aggregate(names, F.length(F.element_at(names, 1)), lambda n, s: F.least(n, F.length(s)))
    first = F.element_at(names, 1)
    sizes = F.filter(F.sequence(F.lit(0), shorter), lambda n: F.forall(names, lambda s: F.substring(s, F.lit(1), n) == F.substring(first, F.lit(1), n)))
    return F.substring(first, F.lit(1), F.array_max(sizes))


def building_name(names: Column, least: int = 3) -> Column:
    """The common beginning of a group's names, or else the shortest of them."""
    shortest = F.element_at(F.array_sort(F.transform(names, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))), 1)["s"]
    head = common_prefix(names)
    return F.when(F.length(head) >= least, head).otherwise(shortest)


def reach_tiers(points: DataFrame, tiers: tuple[float, ...] = (3000.0, 8000.0, 20000.0), enough: int = 3) -> DataFrame:
    """(l_id, tier) of points (id, lat, lng): the smallest radius that holds enough neighbours.

    Points without enough within the largest radius get that radius, and null if none is within it. Only points that a
    radius leaves without enough are looked at with the next one, so that dense places meet their nearest neighbours alone.
    """
    rest, right = points.withColumnRenamed("id", "l_id"), points.withColumnRenamed("id", "r_id")
    found = None
    for tier in tiers:
        near = radius_join(rest, right, tier).where("l_id <> r_id").groupBy("l_id").agg(F.count("*").alias("n"))
        counted = written(rest.join(near, "l_id", "left"), "reach")
        last = tier == tiers[-1]
        done = counted.where(F.lit(True) if last else F.col("n") >= enough).select("l_id", F.when(F.col("n") > 0, F.lit(tier)).alias("tier"))
        found = done if found is None else found.unionByName(done)
        rest = counted.where(F.coalesce("n", F.lit(0)) < enough).drop("n")
    return found


def _closest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the rows (l_id, r_id, metres) that follow each other with one l_id the k of fewest metres, and those as near as the last of them.

    Memory holds a batch and the kept rows of one l_id, so what a join puts out for each of its left rows is not sorted as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            ids, metres = batch.column(0), batch.column(2).to_numpy()
            after, before = ids[1:], ids[:-1]
            new = pc.coalesce(pc.not_equal(after, before), pc.not_equal(after.is_valid(), before.is_valid())).to_numpy(zero_copy_only=False)
            run = np.r_[0, np.cumsum(new)]
            first = np.flatnonzero(np.r_[True, new])
            order = np.lexsort((metres, run))
            last = np.minimum(first + k, np.r_[first[1:], len(run)]) - 1
            near = metres <= metres[order[last]][run]
            yield batch.filter(pa.array(near & (run < run[-1])))
            held = batch.filter(pa.array(near & (run == run[-1])))
        if held is not None:
            yield held

    return run


#: Cells of the finest grid for ``nearest_in_rings`` have this edge in degrees, about eleven metres; each level doubles it.
FINEST, LEVELS = 1e-4, 22


def nearest_in_rings(left: DataFrame, right: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(l_id, r_id, metres, rank): the k nearest rows of right (r_id, lat, lng, keys) for each of left (l_id, lat, lng, keys), whatever the distance.

    Each left row looks for the finest cell around it that holds k rows of its keys; all of them are nearer than the cell's
    diagonal, so the k nearest lie in the three by three cells of twice the edge. Dense places are met in small cells, empty
    ones in large cells, and of rows at one point only the first k by id count. Of the rows of a cell a left row keeps its k nearest
    as they are met, so neither the sort nor the shuffle behind it holds all that it meets. Exact for latitudes up to 45 degrees, away from
    the 180th meridian. Rows without a place, or a key, have no neighbours. Ties go by r_id.
    """
    at_point = W.partitionBy(*keys, "lat", "lng").orderBy("r_id")
    points = right.where("lat is not null and lng is not null").select("r_id", "lat", "lng", *keys).distinct()
    points = written(points.withColumn("_r", F.row_number().over(at_point)).where(F.col("_r") <= k).drop("_r"), "ring-points")

    def cells(lat: str, lng: str, level: Column) -> tuple[Column, Column]:
        edge = F.lit(FINEST) * F.pow(F.lit(2.0), level)
        return F.floor(F.col(lat) / edge), F.floor(F.col(lng) / edge)

    # rows exploded into levels and cells are many more than Spark's estimate of them says: no side of these joins is broadcast
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    grid = points.select("*", levels)
    y, x = cells("lat", "lng", F.col("level"))
    full = written(grid.groupBy(*keys, "level", y.alias("y"), x.alias("x")).agg(F.count("*").alias("n")).where(F.col("n") >= k).drop("n"), "ring-full")
    finest = full.agg(F.min("level")).first()[0]  # one number: no finer cell holds enough
    seekers = written(left.where("lat is not null and lng is not null").select("l_id", F.col("lat").alias("la"), F.col("lng").alias("lo"), *keys), "ring-seekers")
    own_y, own_x = cells("la", "lo", F.col("level"))
    coarser = F.explode(F.sequence(F.lit(LEVELS if finest is None else finest), F.lit(LEVELS))).alias("level")
    level = seekers.select("l_id", "la", "lo", *keys, coarser).withColumn("y", own_y).withColumn("x", own_x).join(full.hint("merge"), [*keys, "level", "y", "x"])
    level = level.groupBy("l_id", "la", "lo", *keys).agg(F.min("level").alias("level"))
    # where no cell holds k rows, the coarsest level is one cell for a hemisphere and its neighbours
    chosen = seekers.join(level.hint("merge"), ["l_id", "la", "lo", *keys], "left")
    # the diagonal in metres of the cell that holds k rows, at the equator and rounded up: no other row is among the k nearest
    chosen = chosen.withColumn("reach", F.coalesce(F.lit(111_196 * math.sqrt(2) * FINEST) * F.pow(F.lit(2.0), "level"), F.lit(math.inf))).withColumn("level", F.least(F.coalesce("level", F.lit(LEVELS)) + 1, F.lit(LEVELS)))
    own_y, own_x = cells("la", "lo", F.col("level"))
    around = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    asked = chosen.withColumn("y", own_y).withColumn("x", own_x).withColumn("o", F.explode(around))
    asked = asked.select("l_id", "la", "lo", "reach", *keys, "level", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    wanted = chosen.select("level").distinct()
    held = grid.join(F.broadcast(wanted), "level", "left_semi")  # at most LEVELS + 1 numbers
    y, x = cells("lat", "lng", F.col("level"))
    near = asked.join(held.withColumn("y", y).withColumn("x", x).hint("merge"), [*keys, "level", "y", "x"])
    near = near.where("abs(la - lat) * 111190 <= reach").withColumn("metres", geo.haversine_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lng")))
    near = near.where("metres <= reach").select("l_id", "r_id", "metres")
    near = near.mapInArrow(_closest(k), near.schema)
    order = W.partitionBy("l_id").orderBy("metres", "r_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
