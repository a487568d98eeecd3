"""Resolving names to entities: exact, by alias, by containment and by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo


def resolve_exact(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, key, state, id, n) of names (name, key) against the registry (key, id): resolved, ambiguous or unresolved."""
    hits = registry.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return names.join(hits, "key", "left").select("name", "key", state.alias("state"), F.when(F.col("n") == 1, F.col("id")).alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


def with_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names (name, key) whose alias (name or key -> target) replaces their key."""
    by_name = aliases.selectExpr("alias as name", "target as t1")
    by_key = aliases.selectExpr("alias as key", "target as t2")
    return names.join(by_name, "name", "left").join(by_key, "key", "left").select("name", F.coalesce("t1", "t2", "key").alias("key"))


def contained(names: DataFrame, registry: DataFrame, gram: int = 4) -> DataFrame:
    """(name, id) pairs where a registry key (key, id, city) of at least ``gram`` characters stands inside a name (name, key, city).

    Cities must agree or be unknown. The first ``gram`` characters of the keys meet all substrings of that size of the
    names in an equi-join, so that names and registry are never compared all with all. Rows with the same key meet as one, and
    only pairs of keys that hold go back to their rows.
    """
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - (gram - 1)), lambda i: F.substring(F.col("key"), i, F.lit(gram))))
    keys = lambda rows: rows.where(F.length("key") >= gram).select("key").distinct()
    a = keys(names).select(F.col("key").alias("long"), F.explode(parts).alias("part"))
    b = keys(registry).select(F.col("key").alias("short"), F.substring("key", 1, gram).alias("part"))
    pairs = a.join(b, "part").where(F.contains("long", "short")).select("long", "short")
    held = pairs.join(registry.select("id", F.col("key").alias("short"), F.col("city").alias("c2")).distinct(), "short")
    rows = names.select("name", F.col("key").alias("long"), F.col("city").alias("c1"))
    ok = F.col("c1").isNull() | F.col("c2").isNull() | (F.col("c1") == F.col("c2"))
    return rows.hint("merge").join(held, "long").where(ok).select("name", "id", "short").distinct()


def unique_contained(names: DataFrame, registry: DataFrame, gram: int = 4) -> DataFrame:
    """(name, id): names with exactly one such registry entry."""
    return contained(names, registry, gram).groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def name_head(name: Column) -> Column:
    """The beginning of a name up to a house or centre."""
    head = F.regexp_extract(name, r"^(.{2,}?(?:館|中心))", 1)
    return F.when(head != "", head)


def cascade(names: DataFrame, *tiers: tuple[str, float, DataFrame]) -> DataFrame:
    """(name, id, method, confidence): each name takes the first tier (method, confidence, (name, id)) that has it."""
    every = None
    for rank, (method, confidence, found) in enumerate(tiers):
        rows = found.select("name", "id", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rank"))
        every = rows if every is None else every.unionByName(rows)
    best = every.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("rank", "id"))).where("r = 1").drop("r", "rank")
    return names.select("name").distinct().join(best, "name", "left").withColumn("method", F.coalesce("method", F.lit("unresolved")))


def same_place(a: DataFrame, b: DataFrame, metres: float = 100.0) -> DataFrame:
    """(a_id, b_id): equal identity keys in one city and within a distance, or else with equal house numbers."""
    left = a.selectExpr("id as a_id", "key", "city as c1", "lat as la1", "lng as lo1", "house as h1")
    right = b.selectExpr("id as b_id", "key", "city as c2", "lat as la2", "lng as lo2", "house as h2")
    located = F.col("la1").isNotNull() & F.col("la2").isNotNull()
    near = geo.haversine_m(F.col("la1"), F.col("lo1"), F.col("la2"), F.col("lo2")) <= metres
    ok = F.when(located, F.col("c1").eqNullSafe(F.col("c2")) & near).otherwise(F.col("h1") == F.col("h2"))
    return left.join(right, "key").where(ok & (F.col("a_id") != F.col("b_id"))).select("a_id", "b_id")


def suffix_keys(key: Column, least: int = 4, drop: int = 2) -> Column:
    """Suffixes of a key of at least ``least`` characters that leave out at least ``drop``, longest first."""
    n = F.length(key) - least - drop + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(key, i + drop + 1, F.length(key)))).otherwise(F.array().cast("array<string>"))


def by_suffix(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, id): the registry entry of the longest suffix of the name's key; none if that suffix has several."""
    rows = names.select("name", F.posexplode(suffix_keys(F.col("key"))).alias("pos", "key")).join(registry.select("key", "id"), "key")
    per = rows.groupBy("name", "pos").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return per.groupBy("name").agg(F.min_by(F.struct("n", "id"), "pos").alias("b")).where("b.n = 1").select("name", "b.id")


def one_to_one(candidates: DataFrame) -> DataFrame:
    """(left, right): the best candidate (left, right, rank, size) of each left, if no other is as good, and once per right."""
    w = W.partitionBy("left").orderBy("rank", F.desc("size"), "right")
    best = candidates.withColumn("r", F.row_number().over(w)).withColumn("n_rank", F.lead("rank").over(w)).withColumn("n_size", F.lead("size").over(w))
    sure = best.where("r = 1 and not (n_rank <=> rank and n_size <=> size)")
    back = W.partitionBy("right").orderBy("rank", F.desc("size"), "left")
    return sure.withColumn("r", F.row_number().over(back)).where("r = 1").select("left", "right")


def disambiguated(candidates: DataFrame, metres: float = 100.0) -> DataFrame:
    """(name, id): among several candidates (name, id, lat, lng, district, street, sources) the most complete one.

    Only where all lie within a distance of the first and in at most one district.
    """
    first = F.first(F.struct("lat", "lng")).over(W.partitionBy("name").orderBy("id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = candidates.withColumn("f", first)
    near = F.coalesce(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("f")["lat"], F.col("f")["lng"]) <= metres, F.lit(False))
    full = F.struct(F.col("lat").isNotNull().alias("g"), F.col("street").alias("s"), F.col("district").isNotNull().alias("d"), F.col("sources").alias("n"), F.reverse(F.col("id").cast("string")).alias("t"))
    agg = rows.groupBy("name").agg(F.min(near.cast("int")).alias("near"), F.count_distinct("district").alias("d"), F.max_by("id", full).alias("id"))
    return agg.where("near = 1 and d <= 1").select("name", "id")


def edges(rows: DataFrame, source: str, predicate: str, target: Column, key: Column, distinct: bool = True) -> DataFrame:
    """(from_id, predicate, to_id, key, state): typed edges, kept also where the target is not known."""
    out = rows.select(F.col(source).alias("from_id"), F.lit(predicate).alias("predicate"), target.alias("to_id"), key.alias("key"))
    out = out.withColumn("state", F.when(F.col("to_id").isNull(), "unresolved").otherwise("resolved"))
    return out.dropDuplicates(["from_id", "predicate", "key"]) if distinct else out


def derived_places(unresolved: DataFrame) -> DataFrame:
    """New places (key, name, sessions) from unresolved rows (key, name, lat, address): those with coordinates or an address."""
    usable = unresolved.where("lat is not null or address is not null")
    return usable.groupBy("key").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count("*").alias("sessions"))


def preferred_names(names: DataFrame) -> DataFrame:
    """(id, name): of several names (id, name, has_page, sessions) one with a page, then an official owner, the formal spelling, most sessions."""
    order = (F.desc("has_page"), F.desc(F.rlike("name", F.lit("^(國立|市立|縣立)"))), F.desc(F.contains("name", F.lit("臺"))), F.desc("sessions"), "name")
    return names.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(*order))).where("r = 1").select("id", "name")


def merged_groups(groups: DataFrame, merges: DataFrame) -> DataFrame:
    """(group, members): groups (group, member) after manual merges (group, into)."""
    into = merges.select("group", F.col("into").alias("_into"))
    rows = groups.join(into, "group", "left").select(F.coalesce("_into", "group").alias("group"), "member")
    return rows.groupBy("group").agg(F.array_sort(F.collect_set("member")).alias("members"))
