"""Entity-resolution graphs: components, cannot-link, stable ids and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

MOST_ROUNDS = 50
#: A join side of ids is broadcast up to so many rows, which are counted.
SMALL_ROWS = 200_000


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected edges (a, b) reach, for every node (id).

    Each round moves every node onto the one of it and its neighbours that stands first in an order of the round's own, and
    its links with it, so that only what stood first somewhere is left. The order is a hash, so in the mean at least half of the
    nodes with links go, whatever the shape of the graph: the number of rounds grows with the logarithm of the nodes, not with the
    length of a chain. Moves are then followed back. Each round is written; none collects neighbours.
    """
    now = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    moves = []
    while now.limit(1).count():
        if len(moves) == MOST_ROUNDS:
            raise RuntimeError("components did not settle")
        place = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c), c)
        first = now.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
        moves.append(written(first.select("a", F.when(place("a") < place("b"), F.col("a")).otherwise(F.col("b")).alias("to")), "cc-moves"))
        ends = [moves[-1].selectExpr(f"a as {c}", f"to as to_{c}") for c in "ab"]
        now = now.join(ends[0], "a").join(ends[1], "b").selectExpr("to_a as a", "to_b as b").where("a <> b").distinct()
        now = written(now, "cc-edges")
    # (a, top): the one node that each node of a round ends on, from the last round to the first
    tops = None
    for move in reversed(moves):
        tops = move.selectExpr("a", "to as top") if tops is None else move.join(tops.selectExpr("a as to", "top as up"), "to", "left").selectExpr("a", "coalesce(up, to) as top")
        tops = written(tops, "cc-tops")
    rows = nodes.select("id").distinct()
    if tops is None:
        return rows.select("id", F.col("id").alias("component"))
    least = tops.groupBy("top").agg(F.min("a").alias("component"))
    return written(rows.join(tops.join(least, "top").selectExpr("a as id", "component"), "id", "left").selectExpr("id", "coalesce(component, id) as component"), "cc-labels")


# Sparse links: all pairs of a rule over one number hold the same components as a few links for each row. Rows are (id, value,
# keys); pairs are of one key, and rows without a key are in none. A value that is missing or not finite is near nothing and far
# from all. Rows of one id are one node.


def _finite(rows: DataFrame, value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return rows.withColumn("_v", F.when(F.abs(number) < float("inf"), number))


def _stars(rows: DataFrame, keys: list[str], order: WindowSpec, linked: Column) -> DataFrame:
    """(a, b): the least id of each stretch of rows that are linked to the row before, with the others of the stretch."""
    stretch = F.sum(F.when(linked, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    first = F.min("id").over(W.partitionBy(*keys, "_stretch"))
    return rows.withColumn("_stretch", stretch).select(first.alias("a"), F.col("id").alias("b")).where("a <> b")


def near_links(rows: DataFrame, keys: list[str], value: str, within: float) -> DataFrame:
    """(a, b) that connect what all pairs of one key with values at most ``within`` apart connect.

    Rows no further than that behind the one before them make a stretch; its least id is linked to all others.
    """
    order = W.partitionBy(*keys).orderBy("_v", "id")
    known = _finite(rows, value).where("_v is not null").dropna(subset=keys).withColumn("_gap", F.col("_v") - F.lag("_v").over(order))
    return _stars(known, keys, order, F.col("_gap") <= within)


def far_links(rows: DataFrame, keys: list[str], value: str, beyond: float) -> DataFrame:
    """(a, b) that connect what all pairs of one key with values more than ``beyond`` apart connect.

    What is far from any row of its key is far from the least or the largest value; a row without a value is far from all.
    """
    rows = _finite(rows, value).dropna(subset=keys)
    ends = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("_v").isNotNull(), F.struct("_v", "id"))).alias("first"),
        F.max(F.when(F.col("_v").isNotNull(), F.struct("_v", "id"))).alias("last"),
        F.min(F.when(F.col("_v").isNull(), F.col("id"))).alias("none"),
    )
    met = rows.join(ends, keys)
    hubs = F.array_compact(
        F.array(
            F.when(F.col("_v") - F.col("first._v") > beyond, F.col("first.id")),
            F.when(F.col("last._v") - F.col("_v") > beyond, F.col("last.id")),
            F.col("none"),
            F.when(F.col("_v").isNull(), F.col("first.id")),
        )
    )
    return met.select(F.explode(hubs).alias("a"), F.col("id").alias("b")).where("a <> b")


def unlike_near_links(rows: DataFrame, keys: list[str], value: str, within: float, kind: str) -> DataFrame:
    """(a, b) that connect what all pairs of one key, of values at most ``within`` apart and of two kinds connect.

    What lies between the rows of such a pair is unlike one of them and near both, so components are stretches in the order of
    values. A pair crosses the step to the next row if that row is near the last one before it of another kind, or the row
    before it is near the first one behind of another kind. A missing kind is unlike all others.
    """
    kinds = F.coalesce(F.concat(F.lit("="), F.col(kind).cast("string")), F.concat(F.lit("?"), F.col("id").cast("string")))
    known = _finite(rows, value).where("_v is not null").dropna(subset=keys).withColumn("_k", kinds)
    order = W.partitionBy(*keys).orderBy("_v", "id", "_k")
    for name, way in (("_back", order), ("_ahead", W.partitionBy(*keys).orderBy(F.desc("_v"), F.desc("id"), F.desc("_k")))):
        known = known.withColumn(name, F.when(F.lag("_k").over(way) != F.col("_k"), F.lag("_v").over(way)))
        known = known.withColumn(name, F.last(name, ignorenulls=True).over(way.rowsBetween(W.unboundedPreceding, W.currentRow)))
    known = known.withColumn("_gap", F.least(F.col("_v") - F.col("_back"), F.lag("_ahead").over(order) - F.lag("_v").over(order)))
    return _stars(known, keys, order, F.col("_gap") <= within)


def eject_blocked(components: DataFrame, blocked: DataFrame) -> DataFrame:
    """Take the larger id of each blocked pair (a, b) out of a shared component, as a component of its own.

    A component that loses its smallest id is named after the smallest that stays.
    """
    pairs = blocked.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct()
    left = components.selectExpr("id as a", "component as ca")
    right = components.selectExpr("id as b", "component as cb")
    out = pairs.join(left, "a").join(right, "b").where("ca = cb").selectExpr("b as id", "true as forced").distinct()
    split = components.join(out, "id", "left").selectExpr("id", "component as was", "coalesce(forced, false) as forced")
    kept = split.where("not forced").groupBy("was").agg(F.min("id").alias("component"))
    return split.where("forced").selectExpr("id", "id as component", "forced").unionByName(split.where("not forced").join(kept, "was").select("id", "component", "forced"))


def inherit_ids(members: DataFrame, previous: DataFrame) -> DataFrame:
    """(component, stable_id) from the members (id, component, forced) of this run and (id, stable_id) of the last.

    A component asks for the old id of its first member that had one; an ejected member (forced) asks for none. Of the
    components that ask for one id, that with the id's old seed (its smallest member) gets it, then the one that keeps most
    of its members, then the smallest. The others are named after their smallest member, with the first number that makes
    the name free among the ids in use, where it is taken.
    """
    seeds = previous.groupBy("stable_id").agg(F.min("id").alias("seed"))
    known = members.where("not forced").join(previous, "id")
    asked = known.groupBy("component").agg(F.min_by("stable_id", "id").alias("stable_id"))
    meets = known.join(asked, ["component", "stable_id"]).join(F.broadcast(seeds) if seeds.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else seeds, "stable_id")
    offers = meets.groupBy("component", "stable_id").agg(F.count("*").alias("kept"), F.max(F.col("id") == F.col("seed")).alias("has_seed"))
    order = W.partitionBy("stable_id").orderBy(F.desc("has_seed"), F.desc("kept"), "component")
    won = offers.withColumn("r", F.row_number().over(order)).where("r = 1").selectExpr("component", "cast(stable_id as string) as stable_id")
    fresh = members.select("component").distinct().join(won, "component", "left_anti").withColumn("base", F.col("component").cast("string"))
    # the numbers in use behind each name: its own counts as 1
    used = won.select("stable_id").union(fresh.select("base")).withColumn("n", F.regexp_extract("stable_id", "-([0-9]+)$", 1).try_cast("int"))
    numbered = used.where("n >= 2").select(F.regexp_replace("stable_id", "-[0-9]+$", "").alias("base"), "n")
    plain = won.selectExpr("stable_id as base", "1 as n")
    numbers = numbered.union(plain).groupBy("base").agg(F.collect_set("n").alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(2), F.size("used") + 2), F.col("used")))
    name = F.when(F.array_contains("used", 1), F.concat("base", F.lit("-"), free.cast("string"))).otherwise(F.col("base"))
    return won.unionByName(fresh.join(numbers, "base", "left").select("component", F.coalesce(name, F.col("base")).alias("stable_id")))


def assign_slugs(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, kind, slug) for rows (id, kind, wanted): the registered slug, else the wanted one with a number where taken."""
    held = rows.join(registry.select("id", "kind", "slug"), ["id", "kind"])
    fresh = rows.join(held, ["id", "kind"], "left_anti")
    used = registry.selectExpr("kind", "regexp_replace(slug, '-[0-9]+$', '') as wanted", "slug").groupBy("kind", "wanted").agg(
        F.max(F.greatest(F.lit(1), F.coalesce(F.regexp_extract("slug", "-([0-9]+)$", 1).try_cast("int"), F.lit(1)))).alias("used")
    )
    order = W.partitionBy("kind", "wanted").orderBy("id")
    numbered = fresh.join(used, ["kind", "wanted"], "left").withColumn("n", F.coalesce("used", F.lit(0)) + F.row_number().over(order))
    named = numbered.selectExpr("id", "kind", "if(n = 1, wanted, concat(wanted, '-', n)) as slug")
    return held.select("id", "kind", "slug").unionByName(named)


def review_queue(pairs: DataFrame, low: float = 0.5, high: float = 0.8, most: int = 12) -> DataFrame:
    """One decision for each component of the pairs (a, b, confidence) in [low, high): members, size and best confidence.

    Links that connect the same rows, with the best confidence of a component among them, can stand for all of its pairs.
    """
    open_pairs = pairs.where((F.col("confidence") >= low) & (F.col("confidence") < high))
    nodes = open_pairs.selectExpr("a as id").union(open_pairs.selectExpr("b as id")).distinct()
    labels = connected_components(nodes, open_pairs.select("a", "b"))
    best = open_pairs.join(labels.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.max("confidence").alias("confidence"))
    sized = labels.groupBy("component").agg(F.count("*").alias("size"))
    rank = W.partitionBy("component").orderBy("id")
    some = labels.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return sized.join(some, "component").join(best, "component").select("component", "size", "members", "confidence")


def successors(retired: DataFrame, candidates: DataFrame, live: DataFrame) -> DataFrame:
    """(key, target, reason): for each retired key its best candidate (key, target, reason, rank) that is live."""
    ok = candidates.join(live.select(F.col("key").alias("target")).distinct(), "target", "left_semi")
    order = W.partitionBy("key").orderBy("rank", "target")
    best = ok.withColumn("r", F.row_number().over(order)).where("r = 1")
    return retired.select("key").distinct().join(best.select("key", "target", "reason"), "key", "left")


def follow(redirects: DataFrame, hops: int = 10) -> DataFrame:
    """(source, target) with chains of redirects followed to their ends, over at most ``hops`` steps; first entries win."""
    now = redirects.select("source", "target")
    for _ in range(max(1, (hops - 1).bit_length())):
        step = now.selectExpr("source as target", "target as next")
        now = written(now.join(step, "target", "left").where("next is null or next <> source").selectExpr("source", "coalesce(next, target) as target"), "redirects")
    return now
