"""The whole cascade that resolves the place names of sessions: to registry venues, or to places that the sessions make.

Names are taken in the order of their sessions, most first, and what an earlier name did can matter to a later one: it may
have made the place that the later one means, or given a registry venue its coordinates. Tiers that look at the registry are
joins over all names at once. Those effects between names are found as a fixpoint: with the effects known so far every name
is resolved, which gives the effects anew, until they stay; a wrong effect is settled at the latest when all earlier names
are, so this ends with what one walk in order would give. Only spellings of one name around one spot are walked in order,
each such group as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .containment import contained_keys
from .graph import connected_components
from .spatial import degrees_for
from .storage import written

SAME_PLACE_M = 100.0
LEAST_CONTAINED, LEAST_IDENTITY, SUFFIX_DROPS = 4, 4, 2

# Words that end the head of a name, the longer ones first, and how long the text before them may be.
HEAD_ENDS = ["分館", "圖書館", "文化中心", "藝術中心", "中心", "館"]
HEAD_LENGTH = (2, 12)

METHODS = {"manual": None, "alias": 1.0, "exact-name": 1.0, "exact-name-merged": 0.9, "name-contains": 0.7, "name-contains-merged": 0.8, "name-head": 0.6, "same-place": 0.85, "derived": 0.9, "none": None}


def head_of(name: Column) -> Column:
    """The shortest beginning of a name that ends in one of HEAD_ENDS; null without one."""
    low, high = HEAD_LENGTH
    return F.nullif(F.regexp_extract(name, f"^.{{{low},{high}}}?(?:{'|'.join(HEAD_ENDS)})", 0), F.lit(""))


def place_names(sessions: DataFrame) -> DataFrame:
    """One row per key of sessions (name, position, city, district, address, precision, lat, lng), aggregated before the shuffle.

    name is the first spelling by position; every other field the first one known, lat and lng together.
    """
    rows = sessions.where("name is not null").withColumn("key", text.norm_venue(F.col("name"))).where("key <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("position", c))).alias(c)
    point = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    per = rows.withColumn("point", point).groupBy("key").agg(
        F.min(F.struct("position", "name")).alias("f"), F.count("*").alias("sessions"), *map(first, ("city", "district", "address", "precision")), first("point"))
    order = F.struct((-F.col("sessions")).alias("s"), F.col("f.position").cast("long").alias("p"), F.col("key").alias("k"))
    return per.select("key", F.col("f.name").alias("name"), "sessions", "city", "district", "address", "precision", "point.lat", "point.lng", order.alias("t"))


def _agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def _same_place(p: str) -> Column:
    """Whether columns with prefix ``n_`` and ``p`` lie at one place: one city, and 100 m or, without coordinates, one house number."""
    c = lambda side, name: F.col(f"{side}{name}")
    located = c("n_", "lat").isNotNull() & c(p, "lat").isNotNull()
    near = geo.haversine_m(c("n_", "lat"), c("n_", "lng"), c(p, "lat"), c(p, "lng")) <= SAME_PLACE_M
    house = F.coalesce(c("n_", "house") == c(p, "house"), F.lit(False))
    return _agree(c("n_", "city"), c(p, "city")) & F.when(located, near).otherwise(house)


def settled(candidates: DataFrame) -> DataFrame:
    """(key, n, id, chosen): candidates (key, ord, id, lat, lng, precision, district, sources) of each name.

    ``id`` is a single candidate's, ``chosen`` the fullest of several that lie within 100 m of the first located one and in at most
    one district: with coordinates, a street address, a district, most sources, the first. Two aggregations, no list.
    """
    full = F.struct(F.col("lat").isNotNull().alias("g"), (F.coalesce("precision", F.lit("")) == "street").alias("s"), F.col("district").isNotNull().alias("d"), F.coalesce("sources", F.lit(0)).alias("n"))
    order = F.struct(F.struct(*(-full[c].cast("long") for c in "gsdn")).alias("full"), "ord", "id")
    located = F.when(F.col("lat").isNotNull(), F.struct("ord", "lat", "lng"))
    one = candidates.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min(order)["id"].alias("best"), F.count_distinct("district").alias("districts"), F.min(located).alias("f"), F.count("lat").alias("located"))
    several = candidates.where("lat is not null").hint("merge").join(one.where("n > 1 and located > 1").select("key", "f"), "key")
    far = several.where(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("f.lat"), F.col("f.lng")) > SAME_PLACE_M).select("key").distinct().withColumn("far", F.lit(True))
    sure = F.col("far").isNull() & (F.col("districts") <= 1)
    return one.hint("merge").join(far, "key", "left").select("key", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(sure, F.col("best")).alias("chosen"))


def resolve(sessions: DataFrame, registry: DataFrame, spellings: DataFrame | None = None, aliases: DataFrame | None = None, rejected: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(key, name, sessions, place, state, method, confidence): what each place name of the sessions means.

    ``sessions`` are (name, position, city, district, address, precision, lat, lng); ``registry`` (id, ord, name, city, district, address,
    precision, lat, lng, sources), ``spellings`` further names (id, name) of its venues; ``aliases`` (alias, target), by spelling or
    key; ``rejected`` (name) are no venues; ``pages`` (name) have a page already.

    Methods in order: manual (rejected), alias, exact-name, exact-name-merged, name-contains (a registry name of a matching city
    holds the name), name-contains-merged, name-head (one holds the name's head), same-place (a registry venue, or a place of other
    sessions, with the same identity key at one place; or a registry venue named by the end of the key), derived (a new place),
    none. exact-name and name-contains are ambiguous where several differ. A derived place is named ``derived:`` and the key of
    its preferred spelling.

    Names that are null or empty are no names. Repeated rows count as sessions. Empty tables give an empty result. Equal
    numbers of sessions go by position, then by key.
    """
    spark = sessions.sparkSession
    strings = lambda df, *columns: df.select(*(F.col(c).cast("string").alias(c) for c in columns)) if df is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    names = place_names(sessions).withColumn("house", geo.norm_address(F.col("address"))).withColumn("idk", geo.venue_identity_key(F.col("name"))).withColumn("hk", text.norm_venue(head_of(F.col("name"))))
    names = written(names, "place-names")
    venues = registry.select(F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), F.col("name").alias("v_name"), *[F.col(c).alias(f"v_{c}") for c in ("city", "district", "precision", "lat", "lng", "sources")], geo.norm_address(F.col("address")).alias("v_house"), geo.venue_identity_key(F.col("name")).alias("v_idk"))
    venues = written(venues, "registry")
    every = venues.select("id", F.col("v_name").alias("name")).unionByName(strings(spellings, "id", "name"))
    known = written(every.withColumn("vkey", text.norm_venue(F.col("name"))).where("vkey <> ''").select("vkey", "id").distinct().hint("merge").join(venues.select("id", "ord"), "id"), "registry-keys")

    # what rejections, aliases and equal keys say
    banned = strings(rejected, "name").distinct().withColumn("banned", F.lit(True))
    renamed = strings(aliases, "alias", "target").groupBy("alias").agg(F.min("target").alias("target"))
    by_name, by_key = renamed.selectExpr("alias as name", "target as t1"), renamed.selectExpr("alias as key", "target as t2")
    looked = names.hint("merge").join(banned, "name", "left").hint("merge").join(by_name, "name", "left").hint("merge").join(by_key, "key", "left").withColumn("target", F.coalesce("t1", "t2"))
    looked = looked.withColumn("wanted", F.when(F.col("target").isNotNull(), text.norm_venue(F.col("target"))).otherwise(F.col("key"))).drop("t1", "t2")
    looked = written(looked, "wanted-names")
    free = looked.where("banned is null")
    exact = free.select("key", F.col("wanted").alias("vkey")).hint("merge").join(known, "vkey").select("key", "id", F.struct(F.lit(0).cast("long").alias("first"), F.lit("").alias("vkey"), "ord").alias("ord"))
    no_exact = free.hint("merge").join(exact.select("key").distinct(), "key", "left_anti").where(F.length("key") >= LEAST_CONTAINED)
    first_of_key = known.groupBy("vkey").agg(F.min("ord").alias("first"))
    indexed = known.hint("merge").join(first_of_key, "vkey").hint("merge").join(venues.select("id", "v_city"), "id")

    def holding(rows: DataFrame, column: str, itself: bool) -> DataFrame:
        """(key, id, ord) of registry names in a matching city that hold a column of the names."""
        pairs = contained_keys(rows.select(F.col(column).alias("key")), known.select(F.col("vkey").alias("key")), LEAST_CONTAINED)
        found = rows.select("key", "city", F.col(column).alias("needle")).hint("merge").join(pairs, "needle").withColumnRenamed("haystack", "vkey").hint("merge").join(indexed, "vkey")
        found = found.where(_agree(F.col("city"), F.col("v_city")))
        return (found if itself else found.where("vkey <> key")).select("key", "id", F.struct("first", "vkey", "ord").alias("ord"))

    contains = holding(no_exact, "key", False)
    headless = no_exact.hint("merge").join(contains.select("key").distinct(), "key", "left_anti")
    heads = holding(headless.where("hk is not null and hk <> key"), "hk", True).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("key", "id")
    tier = lambda df, name: df.select("key", "id", F.lit(name).alias("tier"), "ord")
    tiers = written(tier(exact, "exact-name").unionByName(tier(contains, "name-contains")), "tiers")
    heads = written(heads, "heads")

    # registry venues with the same identity key, or named by its end
    with_place = free.where("(lat is not null or address is not null)").where(F.length("idk") >= LEAST_IDENTITY)
    ends = F.sequence(F.lit(SUFFIX_DROPS), F.length("idk") - LEAST_IDENTITY)
    suffixes = F.when(F.length("idk") - LEAST_IDENTITY >= SUFFIX_DROPS, F.transform(ends, lambda i: F.struct(i.alias("cut"), F.expr("idk").substr(i + 1, F.length("idk")).alias("v_idk"))))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("cut"), F.col("idk").alias("v_idk"))), F.coalesce(suffixes, F.array().cast("array<struct<cut: int, v_idk: string>>")))
    sided = with_place.select("key", "t", *[F.col(c).alias(f"n_{c}") for c in ("city", "lat", "lng", "house")], F.inline(parts))
    alike = written(sided.hint("merge").join(venues.where(F.length("v_idk") >= LEAST_IDENTITY).drop("v_name"), "v_idk"), "alike")

    gained = spark.createDataFrame([], "id string, g_t struct<s: bigint, p: bigint, k: string>, g_lat double, g_lng double")
    made = spark.createDataFrame([], "wanted string, m_t struct<s: bigint, p: bigint, k: string>, m_place string")
    pages_ = strings(pages, "name").distinct()
    while True:
        result, gained_now, made_now = _round(looked, venues, tiers, heads, alike, gained, made, pages_)
        moved = gained_now.exceptAll(gained).limit(1).count() + gained.exceptAll(gained_now).limit(1).count() + made_now.exceptAll(made).limit(1).count() + made.exceptAll(made_now).limit(1).count()
        if not moved:
            return result
        gained, made = gained_now, made_now


def _round(looked: DataFrame, venues: DataFrame, tiers: DataFrame, heads: DataFrame, alike: DataFrame, gained: DataFrame, made: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve all names under the effects known so far: coordinates that registry venues gained, and places that names made."""
    before = F.coalesce(F.col("g_t") < F.col("t"), F.lit(False))
    lat, lng = (F.coalesce(f"v_{c}", F.when(before, F.col(f"g_{c}"))) for c in ("lat", "lng"))
    details = venues.select("id", "v_district", "v_precision", "v_sources", "v_lat", "v_lng")
    candidates = tiers.hint("merge").join(looked.select("key", "t"), "key").hint("merge").join(details, "id").hint("merge").join(gained, "id", "left")
    candidates = candidates.select("key", "tier", "ord", "id", lat.alias("lat"), lng.alias("lng"), F.col("v_precision").alias("precision"), F.col("v_district").alias("district"), F.col("v_sources").alias("sources"))
    by_name = {tier: settled(candidates.where(F.col("tier") == tier)) for tier in ("exact-name", "name-contains")}

    near = alike.hint("merge").join(gained, "id", "left").withColumn("p_lat", lat).withColumn("p_lng", lng).withColumn("p_city", F.col("v_city")).withColumn("p_house", F.col("v_house")).where(_same_place("p_"))
    near = near.select("key", "cut", "ord", "id", F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), F.col("v_precision").alias("precision"), F.col("v_district").alias("district"), F.col("v_sources").alias("sources"))
    # the key itself, then the longest end that finds anything; each may come to nothing
    own = settled(near.where("cut = 0").drop("cut")).select("key", F.coalesce("id", "chosen").alias("own"))
    longest = near.where("cut > 0").groupBy("key").agg(F.min("cut").alias("cut"))
    end = settled(near.hint("merge").join(longest, ["key", "cut"], "left_semi").drop("cut")).select("key", F.coalesce("id", "chosen").alias("end"))

    rows = looked.hint("merge").join(made, "wanted", "left").withColumn("m_place", F.when(F.col("target").isNotNull() & (F.col("m_t") < F.col("t")), F.col("m_place")))
    for tier, p in (("exact-name", "e"), ("name-contains", "c")):
        rows = rows.hint("merge").join(by_name[tier].select("key", F.col("n").alias(f"{p}_n"), F.col("id").alias(f"{p}_id"), F.col("chosen").alias(f"{p}_chosen")), "key", "left")
    rows = rows.hint("merge").join(heads.withColumnRenamed("id", "h_id"), "key", "left").hint("merge").join(own, "key", "left").hint("merge").join(end, "key", "left").withColumn("r_id", F.coalesce("own", "end"))

    what = lambda place, state, method: F.struct(place.cast("string").alias("place"), F.lit(state).alias("state"), F.lit(method).alias("method"))
    null = F.lit(None)
    c = F.col
    decided = (
        F.when(c("banned").isNotNull(), what(null, "rejected", "manual"))
        .when(c("e_id").isNotNull() & c("target").isNotNull(), what(c("e_id"), "resolved", "alias"))
        .when(c("e_id").isNotNull(), what(c("e_id"), "resolved", "exact-name"))
        .when(c("e_chosen").isNotNull(), what(c("e_chosen"), "resolved", "exact-name-merged"))
        .when(c("e_n") > 1, what(null, "ambiguous", "exact-name"))
        .when(c("m_place").isNotNull(), what(c("m_place"), "resolved", "alias"))
        .when(c("c_id").isNotNull(), what(c("c_id"), "resolved", "name-contains"))
        .when(c("c_chosen").isNotNull(), what(c("c_chosen"), "resolved", "name-contains-merged"))
        .when(c("c_n") > 1, what(null, "ambiguous", "name-contains"))
        .when(c("h_id").isNotNull(), what(c("h_id"), "resolved", "name-head"))
        .when(c("lat").isNull() & c("address").isNull(), what(null, "unresolved", "none"))
        .when(c("r_id").isNotNull(), what(c("r_id"), "resolved", "same-place"))
    )
    rows = written(rows.withColumn("d", decided).select("key", "name", "sessions", "t", "idk", "city", "house", "lat", "lng", "d"), "decided")
    derived = written(_named(_founders(rows.where("d is null")), pages), "derived")
    out = rows.hint("merge").join(derived.select("key", "place", "best"), "key", "left")
    own_place = F.when(c("best"), what(c("out_place"), "resolved", "derived")).otherwise(what(c("out_place"), "resolved", "same-place"))
    out = out.withColumnRenamed("place", "out_place").withColumn("d", F.coalesce("d", own_place))
    confidence = F.coalesce(*(F.when((c("d.method") == m) & (c("d.state") == "resolved"), F.lit(v)) for m, v in METHODS.items() if v is not None))
    result = written(out.select("key", "name", "sessions", "d.place", "d.state", "d.method", confidence.alias("confidence")), "resolved")

    blank = venues.where("v_lat is null").select("id")
    fills = rows.where("d.method = 'same-place' and lat is not null").select(c("d.place").alias("id"), "t", "lat", "lng").hint("merge").join(blank, "id", "left_semi")
    gained_now = fills.groupBy("id").agg(F.min(F.struct("t", "lat", "lng")).alias("g")).select("id", c("g.t").alias("g_t"), c("g.lat").alias("g_lat"), c("g.lng").alias("g_lng"))
    made_now = derived.select(c("key").alias("wanted"), c("t").alias("m_t"), c("place").alias("m_place")).hint("merge").join(looked.where("target is not null").select("wanted").distinct(), "wanted", "left_semi")
    return result, written(gained_now, "gained"), written(made_now, "made")


def _groups(rows: DataFrame) -> DataFrame:
    """Rows with the component of spellings that may be one place: one identity key, and neighbouring cells or one address.

    Links lead to the first row of a cell or an address, so a crowded spot costs as many links as rows.
    """
    d = degrees_for(SAME_PLACE_M)
    located = rows.where("lat is not null").withColumn("cell", geo.cell(F.col("lat"), F.col("lng"), d))
    first = written(located.groupBy("idk", "cell").agg(F.min("key").alias("first")), "cells")
    inside = located.hint("merge").join(first, ["idk", "cell"]).selectExpr("key as a", "first as b")
    offsets = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) > (0, 0)))
    near = first.withColumn("o", F.explode(offsets)).select("idk", F.struct((F.col("cell.y") + F.col("o.y")).alias("y"), (F.col("cell.x") + F.col("o.x")).alias("x")).alias("cell"), F.col("first").alias("a"))
    beside = near.hint("merge").join(first, ["idk", "cell"]).selectExpr("a", "first as b")
    housed = rows.where("house is not null")
    houses = housed.hint("merge").join(housed.groupBy("idk", "house").agg(F.min("key").alias("first")), ["idk", "house"]).selectExpr("key as a", "first as b")
    components = connected_components(rows.selectExpr("key as id"), inside.unionByName(beside).unionByName(houses))
    return rows.hint("merge").join(components.withColumnRenamed("id", "key"), "key")


def _founders(rows: DataFrame) -> DataFrame:
    """(key, founder, ...): each name with the name that made its place, walking the names of a group in order.

    A name joins the one place of its identity key that lies where it does; with none, or with several, it makes its own. A place
    has its founder's city, and the first coordinates and address that its names bring. Groups are streams of sorted rows; only the
    places of the present group are held.
    """
    short = rows.where(F.length("idk") < LEAST_IDENTITY).withColumn("founder", F.col("key"))
    grouped = _groups(rows.where(F.length("idk") >= LEAST_IDENTITY))
    columns = ["component", "key", "idk", "city", "house", "lat", "lng"]
    streamed = grouped.repartition("component").sortWithinPartitions("component", "t").select(*columns)
    found = streamed.mapInPandas(_walk, "key string, founder string")
    fields = ["key", "name", "sessions", "t", "founder"]
    return short.select(*fields).unionByName(grouped.hint("merge").join(found, "key").select(*fields))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    component, places = None, []
    for batch in batches:
        founders = []
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
            if row.component != component:
                component, places = row.component, []
            hits = [p for p in places if p["idk"] == row.idk and _one_place(p, row)]
            if len(hits) == 1:
                place = hits[0]
                place["house"] = place["house"] or row.house
                if place["lat"] is None:
                    place["lat"], place["lng"] = row.lat, row.lng
            else:
                place = {"founder": row.key, "idk": row.idk, "city": row.city, "house": row.house, "lat": row.lat, "lng": row.lng}
                places.append(place)
            founders.append(place["founder"])
        yield pd.DataFrame({"key": batch["key"], "founder": founders})


def _one_place(place: dict, row) -> bool:
    if place["city"] and row.city and place["city"] != row.city:
        return False
    if place["lat"] is not None and row.lat is not None:
        return geo.metres(place["lat"], place["lng"], row.lat, row.lng) <= SAME_PLACE_M
    return place["house"] is not None and place["house"] == row.house


def _named(founders: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, t, place, best): the places with the key of their preferred spelling, and whether a name is that one.

    One with a page, then an official owner in front, the formal spelling, most sessions, the name.
    """
    rows = founders.hint("merge").join(pages.withColumn("page", F.lit(True)), "name", "left")
    formal = F.translate("name", "台", "臺")
    order = F.struct(F.col("page").isNull().alias("p"), (~F.rlike(formal, F.lit("^(" + "|".join(geo.OWNERS) + ")"))).alias("o"), F.contains("name", F.lit("台")).alias("t"), (-F.col("sessions")).alias("s"), F.col("name").alias("n"), F.col("key").alias("k"))
    best = rows.groupBy("founder").agg(F.min(order)["k"].alias("preferred"))
    return rows.hint("merge").join(best, "founder").select("key", "t", F.concat(F.lit("derived:"), "preferred").alias("place"), (F.col("key") == F.col("preferred")).alias("best"))
