"""Discovery queries: near, similar, recommended, listed."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .relations import contained
from .spatial import radius_join
from .storage import written

DAY = 86_400


def near_point(rows: DataFrame, lat: float, lng: float, metres: float) -> DataFrame:
    """Rows within a distance of a point; bounds on lat and lng reach the scan."""
    dlat = metres / 111_194.0
    dlng = dlat / max(0.1, math.cos(math.radians(lat)))
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lng").between(lng - dlng, lng + dlng)
    d = geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))
    return rows.where(box).withColumn("metres", d).where(F.col("metres") <= metres)


def radius_search(rows: DataFrame, lat: float, lng: float, metres: float, now: int, days: int = 7, limit: int = 30) -> DataFrame:
    """One row per slug within a distance that starts, or runs, in the coming days; nearest first."""
    soon = near_point(rows, lat, lng, metres).where((F.col("start") < now + days * DAY) & (F.coalesce("end", "start") >= now))
    best = soon.groupBy("slug").agg(F.min(F.struct("metres", "start")).alias("b"))
    return best.select("slug", "b.*").orderBy("metres", "start", "slug").limit(limit)


def map_points(rows: DataFrame, now: int, days: int = 30, cat: str | None = None) -> DataFrame:
    """One located row per slug for the map: its first start from now on."""
    rows = rows.where("lat is not null").where((F.col("start") < now + days * DAY) & (F.coalesce("end", "start") >= now))
    if cat is not None:
        rows = rows.where(F.col("cat") == cat)
    return rows.groupBy("slug").agg(F.min(F.struct("start", "lat", "lng")).alias("p")).select("slug", "p.*")


#: Rows of a city that are looked at at once; pages that need more go on with as many behind them.
CITY_ROWS = 64


def nearby_events(centre: DataFrame, rows: DataFrame, today: int, cap: int = 2, limit: int = 6) -> DataFrame:
    """(page, slug, tier, place) for each page (page, venue, city, slug): other events, of its venue first, then of its city.

    rows: slug, venue, city, series, start and end of events that have not ended; coming ones stand before running ones,
    both by their sort. Events of the venue (tier 0) are not capped; of the city (tier 1) at most ``cap`` of one venue and of
    one series stand on the page, with those of tier 0 counted. Where a slug has several rows, its first one stands for it.
    """
    coming = F.when(F.col("start") >= today, 0).otherwise(1)
    rows = rows.where(F.coalesce("end", "start") >= today).withColumn("_o", F.struct(coming.alias("band"), F.when(coming == 0, F.col("start")).otherwise(F.coalesce("end", "start")).alias("sort"), "slug"))
    entry = F.struct("_o", "slug", F.coalesce(F.col("venue").cast("string"), F.lit("")).alias("venue"), F.coalesce(F.col("series").cast("string"), F.lit("")).alias("series"))

    # the first rows of each venue, one for each slug, as an array in order; ranked in each task before the shuffle
    one = rows.where(F.col("venue").isNotNull()).groupBy("venue", "slug").agg(F.min_by(entry, "_o").alias("e"))
    one = one.withColumn("_r", F.row_number().over(W.partitionBy("venue").orderBy("e._o"))).where(F.col("_r") <= limit + 1)
    of_venue = one.groupBy("venue").agg(F.sort_array(F.collect_list("e")).alias("venue_list"))

    # a page's own slug is all that a venue's list may lose
    pages = centre.select("page", "venue", "city", "slug").join(of_venue, "venue", "left")
    own = F.slice(F.filter(F.coalesce("venue_list", F.array().cast("array<" + rows.select(entry.alias("e")).schema["e"].dataType.simpleString() + ">")), lambda e: e["slug"] != F.col("slug")), 1, limit)
    pages = pages.select("page", "city", "slug", own.alias("own"))

    def step(done: Column, e: Column) -> Column:
        def full(key: str) -> Column:
            return (e[key] != "") & (F.size(F.filter(done, lambda d: d[key] == e[key])) >= cap)

        return F.when((F.size(done) >= limit) | full("venue") | full("series") | (e["slug"] == F.col("slug")) | F.exists(done, lambda d: d["slug"] == e["slug"]), done).otherwise(F.concat(done, F.array(e)))

    # pages that the first rows of their city leave short go on with the rows behind these, part by part
    events = rows.where(F.col("city").isNotNull()).groupBy("city", "slug").agg(F.min_by(entry, "_o").alias("e"))
    state, done, last = pages.select("page", "city", "slug", F.size("own").alias("n"), F.col("own").alias("out")), [], None
    while True:
        ahead = events if last is None else events.join(last, "city").where(F.col("e._o") > F.col("last"))
        first = ahead.withColumn("_r", F.row_number().over(W.partitionBy("city").orderBy("e._o"))).where(F.col("_r") <= CITY_ROWS)
        part = first.groupBy("city").agg(F.sort_array(F.collect_list("e")).alias("part"), F.max("e._o").alias("last"))
        joined = state.join(part, "city", "left").withColumn("out", F.when(F.col("part").isNull(), F.col("out")).otherwise(F.aggregate("part", F.col("out"), step)))
        short = F.coalesce((F.size("out") < limit) & (F.size("part") >= CITY_ROWS), F.lit(False))
        now = written(joined.select("page", "city", "slug", "n", "out", "last", short.alias("short")), "nearby")
        done.append(now.where("not short").select("page", "n", "out"))
        if not now.where("short").limit(1).count():
            break
        state, last = now.where("short").select("page", "city", "slug", "n", "out"), now.where("short").select("city", "last").distinct()
    every = functools.reduce(DataFrame.unionByName, done).select("page", "n", F.posexplode("out").alias("at", "e"))
    return every.select("page", F.col("e.slug").alias("slug"), F.when(F.col("at") < F.col("n"), 0).otherwise(1).alias("tier"), (F.col("at") + 1).alias("place"))


def similar_events(centre: DataFrame, rows: DataFrame, limit: int = 6) -> DataFrame:
    """For each page (page, cat, city, slug) the best rows (slug, cat, city, score) of its category, its city first.

    A page sees at most ``limit`` rows of its city and the best of the category elsewhere, and leaves out itself; so the best
    limit + 1 of each city, and the best 2 limit + 2 of these in the category, hold all that any page can show.
    """
    entry = F.struct((-F.col("score")).alias("low"), "slug", "city").alias("e")
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("e"))
    listed = lambda rows, name, *keys: rows.groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias(name))
    best = rows.where("cat is not null").select("cat", "city", entry).withColumn("_r", rank("cat", "city")).where(F.col("_r") <= limit + 1)
    top = best.withColumn("_r", rank("cat")).where(F.col("_r") <= 2 * limit + 2)
    pages = centre.join(listed(best, "here", "cat", "city"), ["cat", "city"], "left").join(listed(top, "anywhere", "cat"), "cat")
    other = lambda e: e["slug"] != F.col("slug")
    here = F.coalesce(F.slice(F.filter("here", other), 1, limit), F.filter("anywhere", lambda e: F.lit(False)))
    elsewhere = F.filter("anywhere", lambda e: other(e) & ~F.coalesce(e["city"] == F.col("city"), F.lit(False)))
    shown = F.posexplode(F.slice(F.concat(here, elsewhere), 1, limit)).alias("at", "e")
    return pages.select("page", shown).select("page", F.col("e.slug").alias("slug"), (F.col("at") + 1).alias("rank"))


def nearby_venues(near: DataFrame, venues: DataFrame, limit: int = 10) -> DataFrame:
    """For each centre (l_id, r_id, metres) one venue per building: the one with most events, at the group's least distance, on 10 m."""
    rows = near.join(venues.select(F.col("id").alias("r_id"), F.coalesce("building", "id").alias("group"), "events", "name"), "r_id")
    groups = rows.groupBy("l_id", "group").agg(F.max_by("r_id", F.struct("events", F.reverse("name"))).alias("venue"), (F.round(F.min("metres") / 10) * 10).alias("metres"))
    order = W.partitionBy("l_id").orderBy("metres", "venue")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("l_id", "venue", "metres", "rank")


def venues_around(centres: DataFrame, venues: DataFrame, metres: float, limit: int = 10) -> DataFrame:
    """``nearby_venues`` of centres (l_id, lat, lng) among venues (id, lat, lng, building, events, name) within a distance, without its own.

    Each venue has its place in its building beforehand, by events, name and id, so that pairs are reduced as they arise, to a number
    and a distance for each building; they are neither sorted nor shuffled.
    """
    rows = venues.select("id", "lat", "lng", F.coalesce("building", "id").alias("group"), "events", "name")
    order = W.partitionBy("group").orderBy("events", F.reverse("name"), F.desc("id"))
    placed = written(rows.withColumn("place", F.row_number().over(order)), "venue-places")
    near = radius_join(centres, placed.withColumnRenamed("id", "r_id"), metres, ("group", "place")).where("l_id <> r_id")
    best = near.groupBy("l_id", "group").agg(F.max("place").alias("place"), (F.round(F.min("metres") / 10) * 10).alias("metres"))
    groups = best.join(placed.select("group", "place", F.col("id").alias("venue")), ["group", "place"])
    order = W.partitionBy("l_id").orderBy("metres", "venue")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("l_id", "venue", "metres", "rank")


def editor_picks(picks: DataFrame, live: DataFrame, week: Column) -> DataFrame:
    """Picks (week, position, slug, note) of a week that are still live, in order."""
    return picks.where(F.col("week") == week).join(live.select("slug"), "slug", "left_semi").orderBy("position")


def venue_rows(sessions: DataFrame, halls: DataFrame) -> DataFrame:
    """(page, slug, start): sessions of a venue and of its halls (parent, child), once for each slug and start."""
    own = sessions.select(F.col("venue").alias("page"), "slug", "start")
    child = sessions.join(halls, F.col("venue") == F.col("child")).select(F.col("parent").alias("page"), "slug", "start")
    return own.unionByName(child).distinct()


def hub_matrix(rows: DataFrame, least: int = 5) -> DataFrame:
    """(hub, city, n) of pages worth building: each hub flag by city, and all cities together; only those with enough events."""
    flags = F.explode(F.filter(F.array(F.when(F.col("weekend"), F.lit("weekend")), F.when(F.col("free"), F.lit("free")), F.concat(F.lit("year-"), F.col("year").cast("string"))), lambda x: x.isNotNull()))
    hubs = rows.select("slug", "city", flags.alias("hub"))
    by_city = hubs.groupBy("hub", "city").agg(F.count_distinct("slug").alias("n"))
    total = hubs.groupBy("hub").agg(F.count_distinct("slug").alias("n")).select("hub", F.lit("all").alias("city"), "n")
    return by_city.unionByName(total).where(F.col("n") >= least)


def mood_rotation(rows: DataFrame, seed: int, per_mood: int = 2) -> DataFrame:
    """Rows (slug, mood) of today's home page: order turned by the day, at most some of each mood."""
    w = W.partitionBy("mood")
    place = F.pmod(F.row_number().over(w.orderBy("slug")) - 1 - seed, F.count("*").over(w))
    return rows.withColumn("place", place).where(F.col("place") < per_mood)


def review_suggestions(names: DataFrame, registry: DataFrame, limit: int = 5) -> DataFrame:
    """For each open name (name, key, city) up to ``limit`` registry entries that stand inside it, the longest first."""
    order = W.partitionBy("name").orderBy(F.desc(F.length("short")), "id")
    return contained(names, registry).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("name", "id", "rank")


def text_index(rows: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, n): counts for a plain-text overview, of one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return rows.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def borrowed_place(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events (venue, city, district) take a missing city from their venue, unless the districts conflict."""
    v = venues.selectExpr("id as venue", "city as vc", "district as vd")
    fits = F.col("district").isNull() | F.col("vd").isNull() | (F.col("district") == F.col("vd"))
    both = events.join(v, "venue", "left")
    return both.withColumn("city", F.coalesce("city", F.when(fits, F.col("vc")))).withColumn("district", F.coalesce("district", F.when(fits, F.col("vd")))).drop("vc", "vd")


def first_rule(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The result of the first pattern that fits."""
    out = F.lit(None).cast("string")
    for pattern, result in reversed(rules):
        out = F.when(F.rlike(value, F.lit(pattern)), F.lit(result)).otherwise(out)
    return out


def first_of_group(pages: DataFrame, venues: DataFrame, group: str, most: int) -> DataFrame:
    """(page, venue): for each page (page, group) the first venues (venue, group) of its group other than itself.

    Only the first ``most`` + 1 of a group can be such, so a group is cut to them before it meets its pages.
    """
    first = venues.where(F.col(group).isNotNull()).withColumn("r", F.row_number().over(W.partitionBy(group).orderBy("venue"))).where(F.col("r") <= most + 1)
    pairs = pages.join(first, group).where("page <> venue")
    return pairs.withColumn("k", F.row_number().over(W.partitionBy("page").orderBy("venue"))).where(F.col("k") <= most).select("page", "venue")


def heritage_page(sessions: DataFrame, venues: DataFrame, today: int, keep: DataFrame | None = None, here: int = 20, near: int = 8, per_venue: int = 2) -> DataFrame:
    """(page, part, rank, slug, venue, start): what a heritage page lists at its own venues and around.

    ``venues`` (page, venue, part) names a page's own venues ('site') and those nearby ('near'); sessions are (slug, venue, start,
    end). ``here`` are events at its own venues that have not ended, running ones by their end before coming ones by start, or
    else, as ``past``, the latest. ``near`` are coming, then running events of nearby venues that are not listed here, each once, at
    its first place, and at most ``per_venue`` of a venue; ``keep`` (slug) says which may be listed there.

    In order, a row of ``near`` is taken as long as its venue has fewer than ``per_venue``: the rows taken of a venue are its first,
    so places within venue and page decide, and no list is walked. Sessions meet pages as one row for each venue and slug. Rows
    without a venue, a slug or a start are at no page; empty tables give an empty result.
    """
    end = F.coalesce("end", "start")
    live, running = end >= today, F.col("start") < today
    own = F.struct(F.when(~live, 2).when(running, 0).otherwise(1).alias("band"), F.when(~live, -F.col("start")).when(running, end).otherwise(F.col("start")).alias("at"), "start")
    around = F.when(live, F.struct(F.when(running, 1).otherwise(0).alias("band"), F.when(running, end).otherwise(F.col("start")).alias("at"), "start"))
    events = sessions.where("venue is not null and slug is not null and start is not null").groupBy("venue", "slug").agg(F.min(own).alias("own"), F.min(around).alias("around"))
    pages = venues.select("page", "venue", "part").distinct()

    def first_of_slug(part: str, order: str) -> DataFrame:
        rows = pages.where(F.col("part") == part).join(events.where(F.col(order).isNotNull()), "venue")
        place = F.struct(F.col(f"{order}.band").alias("band"), F.col(f"{order}.at").alias("at"), "slug", "venue", F.col(f"{order}.start").alias("start"))
        return rows.groupBy("page", "slug").agg(F.min(place).alias("o"))

    at_page = W.partitionBy("page").orderBy("o")
    sites = first_of_slug("site", "own").withColumn("first", F.min("o.band").over(W.partitionBy("page"))).where((F.col("o.band") < 2) | (F.col("first") == 2))
    listed = sites.withColumn("rank", F.row_number().over(at_page)).where(F.col("rank") <= here)
    others = first_of_slug("near", "around").join(listed.select("page", "slug"), ["page", "slug"], "left_anti")
    if keep is not None:
        others = others.join(keep.select("slug").distinct(), "slug", "left_semi")
    others = others.withColumn("v", F.row_number().over(W.partitionBy("page", "o.venue").orderBy("o"))).where(F.col("v") <= per_venue)
    others = others.withColumn("rank", F.row_number().over(at_page)).where(F.col("rank") <= near)
    shown = lambda df, part: df.select("page", part.alias("part"), "rank", "slug", F.col("o.venue").alias("venue"), F.col("o.start").alias("start"))
    return shown(listed, F.when(F.col("first") == 2, "past").otherwise("here")).unionByName(shown(others, F.lit("near")))
