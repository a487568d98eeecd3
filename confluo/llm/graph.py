"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Far above the logarithm of any diameter; reaching it means a fault.
ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (src, dst); component is the smallest id that links reach.

    Each step lets every node tell its neighbours the smallest id it sees: first the larger neighbours, then the smaller
    ones. Minima are aggregated before each shuffle, neighbour lists are never collected, and each round is written to the
    shared folder, so a lost executor costs no more than a round.
    """
    now = written(edges.selectExpr("greatest(src, dst) as u", "least(src, dst) as v").where("u is not null and u <> v").distinct(), "edges")
    print_of = _print(now)
    for _ in range(ROUNDS):
        if not print_of[0]:
            break
        both = now.union(now.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").union(now.join(low, "u").selectExpr("u", "m as v").where("u <> v")).where("u <> v").distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v as u", "m as v").where("u <> v").union(least.selectExpr("u", "m as v")).distinct()
        now = written(small, "small-star")
        before, print_of = print_of, _print(now)
        if print_of == before:
            break
    else:
        raise RuntimeError("components did not settle")
    found = now.groupBy("u").agg(F.min("v").alias("component")).selectExpr("u as id", "component")
    return found.union(now.selectExpr("v as id", "v as component").distinct().join(found.select("id"), "id", "left_anti"))


def _print(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and a sum that changes with them."""
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return n, total or 0
