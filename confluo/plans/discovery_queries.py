"""Discovery queries; embeddings give places, orders give sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, discovery, spatial
from ..sources import sinks
from .calendar_queries import DAY, SESSIONS, TODAY, sessions
from .entity_queries import METRES, POINTS, points
from .registry import query, table

HERE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(24.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(24.0)) * pow(sin(radians(121.0 - lng) / 2), 2))))"


@query("q26_radius_search", f"WITH {POINTS}, d AS (SELECT id AS slug, {HERE} AS m FROM p) SELECT slug, CAST(round(m) AS BIGINT) AS metres FROM d WHERE m <= 10000 ORDER BY m, slug LIMIT 30")
def radius_search(spark, sf_dir):
    rows = points(spark, sf_dir).selectExpr("id as slug", "lat", "lng", "10 as start", "cast(null as int) as end")
    return discovery.radius_search(rows, 24.0, 121.0, 10_000, 0).select("slug", F.round("metres").cast("long").alias("metres"))


@query("q27_map_points", f"WITH {POINTS} SELECT id AS slug, min(id) AS start_s FROM p GROUP BY 1")
def map_points_all(spark, sf_dir):
    """Every point: each has a slug of its own, and the days are so many that all starts lie within."""
    rows = points(spark, sf_dir).selectExpr("id as slug", "id as start", "cast(null as long) as end", "lat", "lng")
    return discovery.map_points(rows, 0, days=1 << 40).selectExpr("slug", "start as start_s")


@query("q15_nearby_events")
def nearby_events(spark, sf_dir):
    """Events of the same venue and then of the city for every order's page, with caps on venue and series in the city."""
    rows = calendar.upcoming(sessions(spark, sf_dir), TODAY).withColumn("series", F.col("cat"))
    centre = sessions(spark, sf_dir).select(F.col("slug").alias("page"), "venue", "city", "slug")
    return discovery.nearby_events(centre, rows, TODAY).select("page", "slug", "tier", F.col("place").cast("long").alias("place"))


@query("q18_similar_events", f"""WITH {SESSIONS}, c AS (SELECT * FROM s), r AS (SELECT c.slug AS page, s.slug, row_number() OVER (PARTITION BY c.slug ORDER BY CASE WHEN s.city = c.city THEN 0 ELSE 1 END, s.popularity DESC, s.slug) AS rank
    FROM c JOIN s ON c.cat = s.cat AND c.slug <> s.slug) SELECT page, slug, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def similar_events(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("score", F.col("popularity"))
    return discovery.similar_events(rows.select(F.col("slug").alias("page"), "cat", "city", "slug"), rows.select("slug", "cat", "city", "score"))


@query("q19_nearby_venues", f"""WITH {POINTS}, d AS (SELECT a.id AS l_id, b.id AS r_id, {METRES} AS m FROM p a JOIN p b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.03 WHERE {METRES} <= 2000),
    g AS (SELECT l_id, r_id % 10 AS grp, max(r_id) AS venue, round(min(m) / 10) * 10 AS metres FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY metres, venue) AS rank FROM g)
    SELECT l_id, venue, CAST(metres AS BIGINT) AS metres, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def nearby_venues(spark, sf_dir):
    p = points(spark, sf_dir)
    venues = p.select("*", (F.col("id") % 10).alias("building"), F.col("id").alias("events"), F.lit("v").alias("name"))
    return discovery.venues_around(p.withColumnRenamed("id", "l_id"), venues, 2000).withColumn("metres", F.col("metres").cast("long"))


@query("q21_district_pages", f"WITH {SESSIONS} SELECT city, venue % 5 AS district, count(*) FILTER (e >= {TODAY}) AS live, max(e) AS latest FROM s GROUP BY 1, 2 HAVING count(*) >= 5")
def district_pages(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("e", F.coalesce("end", "start"))
    per = rows.groupBy("city", (F.col("venue") % 5).alias("district")).agg(F.count(F.when(F.col("e") >= TODAY, 1)).alias("live"), F.max("e").alias("latest"), F.count("*").alias("n"))
    return per.where("n >= 5").drop("n")


@query("q23_city_tops", f"""WITH {SESSIONS}, c AS (SELECT city, venue, count(DISTINCT slug) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, venue) AS rank FROM c) SELECT city, venue, n FROM r WHERE rank <= 8""")
def city_tops(spark, sf_dir):
    from ..operators.ranking import top_per_group

    counts = sessions(spark, sf_dir).groupBy("city", "venue").agg(F.count_distinct("slug").alias("n"))
    return top_per_group(counts, ["city"], 8, F.desc("n"), "venue").select("city", "venue", "n")


@query("q30_venue_rows", f"WITH {SESSIONS} SELECT venue AS page, count(*) AS n FROM (SELECT venue, slug, start_s FROM s UNION SELECT venue % 10 + 1000, slug, start_s FROM s) GROUP BY 1")
def venue_rows(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    halls = rows.select(F.col("venue").alias("child")).distinct().withColumn("parent", F.col("child") % 10 + 1000)
    return discovery.venue_rows(rows, halls).groupBy("page").agg(F.count("*").alias("n"))


@query("q31_venues_list", f"WITH {SESSIONS} SELECT venue, bool_or(e >= {TODAY}) AS active, count(*) AS n FROM s GROUP BY 1")
def venues_list(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("venue").agg(F.bool_or(F.coalesce("end", "start") >= TODAY).alias("active"), F.count("*").alias("n"))


@query("q33_mood_rotation", "SELECT p_partkey, mood, CAST(place AS BIGINT) AS place FROM (SELECT p_partkey, p_brand AS mood, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 - 5) % n + n) % n AS place FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part)) WHERE place < 2")
def mood_rotation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("mood"))
    return discovery.mood_rotation(rows, 5).select(F.col("slug").alias("p_partkey"), "mood", F.col("place").cast("long").alias("place"))


@query("q37_hub_matrix", f"""WITH {SESSIONS}, h AS (SELECT slug, city, unnest(list_filter([CASE WHEN start_s < {TODAY + DAY} AND e >= {TODAY - DAY} THEN 'weekend' END, CASE WHEN popularity < 20000 THEN 'free' END, 'year-' || year(make_timestamp((start_s + 28800) * 1000000))], lambda x: x IS NOT NULL)) AS hub FROM s)
    SELECT hub, city, count(DISTINCT slug) AS n FROM h GROUP BY 1, 2 HAVING count(DISTINCT slug) >= 5 UNION ALL SELECT hub, 'all', count(DISTINCT slug) FROM h GROUP BY 1 HAVING count(DISTINCT slug) >= 5""")
def hub_matrix(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    weekend = (F.col("start") < TODAY + DAY) & (F.coalesce("end", "start") >= TODAY - DAY)
    flagged = rows.select("slug", "city", weekend.alias("weekend"), (F.col("popularity") < 20000).alias("free"), F.year(calendar.local_day(F.col("start"))).alias("year"))
    return discovery.hub_matrix(flagged)


@query("q42_text_index", f"WITH {SESSIONS} SELECT 'cat' AS dimension, cat AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'city', city, count(*) FROM s GROUP BY 2")
def text_index(spark, sf_dir):
    return discovery.text_index(sessions(spark, sf_dir), "cat", "city")


@query("j15_borrowed_place", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_orderkey % 2 = 0 OR c_nationkey % 2 = 0 THEN 'city-' || c_nationkey END AS city FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def borrowed_place(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("venue"), F.when(F.col("o_orderkey") % 3 == 0, "own").alias("city"), F.when(F.col("o_orderkey") % 2 == 1, "even").alias("district"))
    venues = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("city-"), F.col("c_nationkey").cast("string")).alias("city"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("district"))
    return discovery.borrowed_place(events, venues).select("o_orderkey", "city")


@query("j20_first_rule", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'hardware' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'coloured' WHEN regexp_matches(p_name, 'gear') THEN 'gear' END AS category FROM part")
def first_rule(spark, sf_dir):
    rules = [("ring|bolt", "hardware"), ("^(red|blue)", "coloured"), ("gear", "gear")]
    return table(spark, sf_dir, "part").select("p_partkey", discovery.first_rule(F.col("p_name"), rules).alias("category"))


@query("s18_serving_index", f"WITH {SESSIONS} SELECT row_number() OVER (ORDER BY slug) - 1 AS ordinal, slug, start_s FROM s")
def serving_index(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    events, index = sinks.serving_index(rows.select("slug", "title", "cat"), rows.select("slug", "start"))
    return sinks.read_index(events.select("ordinal", "slug"), index).join(events.select("slug", "ordinal"), "slug").selectExpr("ordinal", "slug", "start as start_s")


@query("s21_venue_names", "SELECT n_name AS name, 'slug-' || n_nationkey AS slug, CAST(1 AS BIGINT) AS n FROM nation")
def venue_names(spark, sf_dir):
    venues = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("slug-"), F.col("n_nationkey").cast("string")).alias("slug"), F.array(F.lower("n_name"), F.col("n_name")).alias("aliases"))
    return sinks.venue_names(venues).select("name", "slug", F.size("aliases").cast("long").alias("n"))


@query("s24_sitemap", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN DATE '2024-01-05' ELSE DATE '2024-02-01' END AS lastmod FROM documents WHERE doc_id % 8 <> 0 OR doc_id % 4 <> 0")
def sitemap(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    state = pages.where("doc_id % 4 = 0").select("path", (F.col("doc_id") % 8 != 0).alias("indexable"), F.lit("2024-01-05").cast("date").alias("changed_at"))
    return sinks.sitemap(pages.select("path"), state, F.lit("2024-02-01").cast("date"))


@query("s22_delivery_checks", "SELECT CAST(n_nationkey AS VARCHAR) AS source, CASE WHEN n_nationkey % 7 = 0 THEN 'unknown' ELSE concat_ws(',', CASE WHEN n_nationkey % 5 = 0 THEN 'checksum' END, CASE WHEN n_nationkey % 3 = 0 THEN 'shrunk' END) END AS failed FROM nation")
def delivery_checks(spark, sf_dir):
    k, day = F.col("n_nationkey"), F.lit("2024-01-02").cast("date")
    rows = table(spark, sf_dir, "nation").withColumn("source", k.cast("string"))
    delivered = rows.select("source", F.lit("a").alias("sha256"), F.lit(10).alias("bytes"), F.lit(10).alias("rows"), day.alias("fetched_at"))
    manifest = rows.where(k % 7 != 0).select("source", F.when(k % 5 == 0, "b").otherwise("a").alias("m_sha256"), F.lit(10).alias("m_bytes"), F.lit(10).alias("m_rows"))
    current = rows.where(k % 7 != 0).select("source", F.when(k % 3 == 0, 30).otherwise(12).alias("c_rows"), F.date_sub(day, 1).alias("c_fetched_at"))
    return sinks.delivery_checks(delivered, manifest, current)
