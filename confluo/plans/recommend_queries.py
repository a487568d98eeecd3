"""Recommendations and heritage pages on the shop's items, lines, clients and vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, ranking, recommend
from ..operators.recommend import MOOD_CATEGORIES, MOOD_WORDS, NEVER_CATEGORIES, NEVER_WORDS, NO_MOOD
from .registry import query, table

#: Wednesday 6 March 2024, ten o'clock in UTC+8.
NOW = 1_709_690_400
TODAY = NOW - 10 * 3600
SEED = 7

TITLE = "CASE item_id % 9 WHEN 0 THEN '手作' || name WHEN 1 THEN '夜市' || name WHEN 2 THEN '徵件' || name WHEN 3 THEN '海邊書店' || name ELSE name END"
CATEGORY = "CASE item_id % 7 WHEN 0 THEN '展覽' WHEN 1 THEN '市集' WHEN 2 THEN '講座' WHEN 3 THEN '競賽' WHEN 4 THEN '節慶活動' WHEN 5 THEN '其他' END"
LAT, LNG = "CASE WHEN item_id % 6 > 0 THEN 23 + item_id * 7919 % 10007 * 0.0001 END", "CASE WHEN item_id % 6 > 0 THEN 121 + item_id * 6101 % 9973 * 0.0001 END"
START = "CAST(floor(epoch(shipped_at)) AS BIGINT) + quantity % 24 * 3600"
SESSIONS = f"""s0 AS (SELECT item_id AS slug, sale_id * 100 + line_no AS position, line_no % 4 = 0 AS date_only, {START} AS start, line_no FROM sale_lines WHERE shipped_at IS NOT NULL AND quantity IS NOT NULL),
    s AS (SELECT *, CASE line_no % 3 WHEN 0 THEN start + 108000 WHEN 1 THEN start + 7200 END AS e FROM s0),
    l AS (SELECT *, coalesce(date_only, false) OR coalesce(e - start > 72000, false) AS long, coalesce(e, start + 86400) AS until FROM s)"""


def _words(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


MOODS = ", ".join(f"CASE WHEN {_in('cat', MOOD_CATEGORIES[m])} OR {_words('title', MOOD_WORDS[m])} THEN '{m}' END" for m in MOOD_CATEGORIES)
POOL = f"""i AS (SELECT item_id AS slug, item_id % 10 = 0 AS heritage, coalesce({TITLE}, '') AS title, coalesce({CATEGORY}, '') AS cat, coalesce(price, 0) AS score, CAST({LAT} AS DOUBLE) AS lat, CAST({LNG} AS DOUBLE) AS lng FROM items),
    m AS (SELECT *, CASE WHEN heritage THEN ['escape', 'solo'] WHEN {_in('cat', NEVER_CATEGORIES)} OR {_words('title', NEVER_WORDS)} THEN [] ELSE list_filter([{MOODS}], lambda x: x IS NOT NULL) END AS found, {_in('cat', NEVER_CATEGORIES)} OR {_words('title', NEVER_WORDS)} AS never FROM i),
    fit AS (SELECT *, unnest(list_append(CASE WHEN len(found) > 0 THEN found ELSE ['{NO_MOOD}'] END, 'now')) AS mood FROM m WHERE heritage OR NOT never),
    spans AS (SELECT * FROM (VALUES {", ".join(f"('{s.name}', {s.start}, {s.end}, {str(s.night).lower()})" for s in recommend.spans(NOW))}) AS t(span, lo, hi, night)),
    offers AS (SELECT slug, span, min(CASE WHEN NOT long AND start >= lo AND start < hi THEN start END) AS timed, arg_min(until, {{'n': position IS NULL, 'p': position, 's': start, 'u': until}}) FILTER (long AND start < hi AND until > lo AND NOT night) AS opens FROM l, spans GROUP BY 1, 2),
    matched AS (SELECT span, mood, f.slug, CASE WHEN f.heritage THEN 'place' WHEN timed IS NOT NULL THEN 'timed' ELSE 'open' END AS kind, CASE WHEN NOT f.heritage THEN coalesce(timed, opens) END AS moment, score, f.heritage, lat, lng
        FROM fit f JOIN offers o ON o.slug = f.slug WHERE NOT f.heritage AND coalesce(timed, opens) IS NOT NULL UNION ALL SELECT span, mood, slug, 'place', NULL, score, true, lat, lng FROM fit, spans WHERE heritage AND NOT night)"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "items").selectExpr("item_id as slug", "item_id % 10 = 0 as heritage", f"{TITLE} as title", f"{CATEGORY} as cat", "price as score", f"cast({LAT} as double) as lat", f"cast({LNG} as double) as lng")
    heritage = F.array(*map(F.lit, recommend.HERITAGE_MOODS))
    items = items.withColumn("moods", F.when(F.col("heritage"), heritage).otherwise(recommend.moods_of(F.col("cat"), F.col("title"))))
    start = F.unix_seconds(F.col("shipped_at").cast("timestamp")) + F.col("quantity") % 24 * 3600
    lines = table(spark, sf_dir, "sale_lines").select(F.col("item_id").alias("slug"), (F.col("sale_id") * 100 + F.col("line_no")).alias("position"), start.alias("start"), (F.col("line_no") % 4 == 0).alias("date_only"), "line_no")
    end = F.when(F.col("line_no") % 3 == 0, F.col("start") + 108_000).when(F.col("line_no") % 3 == 1, F.col("start") + 7200)
    return items, lines.withColumn("end", end)


@query("q28_availability", f"""WITH {SESSIONS}, {POOL},
    r AS (SELECT *, row_number() OVER (PARTITION BY span, mood, kind = 'timed' ORDER BY CASE kind WHEN 'timed' THEN moment ELSE 0 END, score DESC, kind <> 'timed' AND heritage, slug) AS r FROM matched),
    t AS (SELECT *, row_number() OVER (PARTITION BY span, mood ORDER BY r, kind = 'timed' DESC) AS rank FROM r)
    SELECT span, mood, CAST(rank AS INTEGER) AS rank, slug, kind, moment AS "at" FROM t WHERE rank <= 40""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sessions = _pool(spark, sf_dir)
    return recommend.recommended(recommend.matches(items, sessions, recommend.spans(NOW)))


PEOPLE = """p AS (SELECT client_id AS person, CASE client_id % 4 WHEN 0 THEN 'soon' WHEN 1 THEN 'tonight' WHEN 2 THEN 'halfday' ELSE 'weekend' END AS span,
    CASE client_id % 5 WHEN 0 THEN 'solo' WHEN 1 THEN 'friends' WHEN 2 THEN 'escape' WHEN 3 THEN 'different' ELSE 'now' END AS mood,
    CAST(CASE WHEN balance IS NOT NULL THEN 23 + client_id * 3571 % 9901 * 0.0001 END AS DOUBLE) AS plat, CAST(CASE WHEN balance IS NOT NULL THEN 121 + client_id * 2797 % 9887 * 0.0001 END AS DOUBLE) AS plng,
    client_id * 13 % 400 AS seen FROM clients)"""
METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2))))"
NEAREST = f"""d AS (SELECT person, slug, CASE WHEN lat IS NOT NULL THEN {METRES} END AS metres FROM p JOIN matched USING (span, mood) WHERE plat IS NOT NULL),
    n AS (SELECT person, slug, metres, row_number() OVER (PARTITION BY person ORDER BY metres NULLS LAST, slug) AS rank FROM d)"""


def _nearest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, sessions = _pool(spark, sf_dir)
    sql = PEOPLE.removeprefix("p AS (").removesuffix(")").replace("FROM clients", "FROM {clients}")
    people = spark.sql(sql, clients=table(spark, sf_dir, "clients")).withColumnsRenamed({"plat": "lat", "plng": "lng"})
    return people, recommend.nearest(people, recommend.matches(items, sessions, recommend.spans(NOW)), items)


@query("q29_nearest_of_list", f"WITH {SESSIONS}, {POOL}, {PEOPLE}, {NEAREST} SELECT person, slug, CAST(rank AS INTEGER) AS rank, CAST(round(metres) AS BIGINT) AS metres FROM n WHERE rank <= 40")
def nearest_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every client with a point the nearest of the list for a span and a mood."""
    return _nearest(spark, sf_dir)[1].withColumn("metres", F.round("metres").cast("long"))


@query("q29_pick", f"""WITH {SESSIONS}, {POOL}, {PEOPLE}, {NEAREST}
    SELECT person, arg_min(slug, {{'s': slug < 1200 AND slug % 3 = seen % 3, 'd': md5(concat_ws('|', {SEED}, person, slug)), 'g': slug}}) AS slug FROM n JOIN p USING (person) WHERE rank <= 40 GROUP BY 1""")
def pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the nearest for every client, not among the items seen."""
    people, found = _nearest(spark, sf_dir)
    seen = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: k * 3 + F.col("seen") % 3)
    return recommend.picked(found, people.select("person", "seen"), SEED, seen=seen)


#: Every vendor is a page with its own stand as site; the first ten others of its nation are near.
PAGES = """pg AS (SELECT vendor_id AS page, vendor_id AS venue, 'site' AS part FROM vendors UNION ALL
    SELECT a, b, 'near' FROM (SELECT a.vendor_id AS a, b.vendor_id AS b, row_number() OVER (PARTITION BY a.vendor_id ORDER BY b.vendor_id) AS r FROM vendors a JOIN vendors b ON a.nation_id = b.nation_id AND a.vendor_id <> b.vendor_id) WHERE r <= 10)"""


@query("q16_heritage_page", f"""WITH {PAGES}, s AS (SELECT item_id AS slug, vendor_id AS venue, {START} AS start, {START} + line_no % 5 * 86400 AS e FROM sale_lines WHERE shipped_at IS NOT NULL AND quantity IS NOT NULL AND vendor_id IS NOT NULL AND item_id IS NOT NULL),
    o AS (SELECT *, CASE WHEN e < {TODAY} THEN 2 WHEN start < {TODAY} THEN 0 ELSE 1 END AS band FROM s),
    h0 AS (SELECT page, slug, venue, start, band, CASE band WHEN 2 THEN -start WHEN 0 THEN e ELSE start END AS moment, min(band) OVER (PARTITION BY page) AS first FROM o JOIN pg USING (venue) WHERE part = 'site'),
    h1 AS (SELECT *, row_number() OVER (PARTITION BY page, slug ORDER BY band, moment, venue, start) AS r FROM h0 WHERE band < 2 OR first = 2),
    h AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, moment, slug, venue, start) AS rank FROM h1 WHERE r = 1),
    n0 AS (SELECT page, slug, venue, start, 1 - band AS band, CASE band WHEN 0 THEN e ELSE start END AS moment FROM o JOIN pg USING (venue) WHERE part = 'near' AND band < 2),
    n1 AS (SELECT *, row_number() OVER (PARTITION BY page, slug ORDER BY band, moment, venue, start) AS r FROM n0),
    n2 AS (SELECT *, row_number() OVER (PARTITION BY page, venue ORDER BY band, moment, slug, start) AS v FROM n1 WHERE r = 1 AND (page, slug) NOT IN (SELECT (page, slug) FROM h WHERE rank <= 20)),
    n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, moment, slug, venue, start) AS rank FROM n2 WHERE v <= 2)
    SELECT page, CASE first WHEN 2 THEN 'past' ELSE 'here' END AS part, CAST(rank AS INTEGER) AS rank, slug, venue, start FROM h WHERE rank <= 20 UNION ALL SELECT page, 'near', CAST(rank AS INTEGER), slug, venue, start FROM n WHERE rank <= 8""")
def heritage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_seconds(F.col("shipped_at").cast("timestamp")) + F.col("quantity") % 24 * 3600
    sessions = table(spark, sf_dir, "sale_lines").select(F.col("item_id").alias("slug"), F.col("vendor_id").alias("venue"), start.alias("start"), (start + F.col("line_no") % 5 * 86_400).alias("end"))
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", "nation_id")
    other = vendors.select(F.col("vendor_id").alias("venue"), "nation_id")
    pairs = discovery.first_of_group(vendors.withColumnRenamed("vendor_id", "page"), other, "nation_id", 10)
    pages = vendors.select(F.col("vendor_id").alias("page"), F.col("vendor_id").alias("venue"), F.lit("site").alias("part"))
    return discovery.heritage_page(sessions, pages.unionByName(pairs.withColumn("part", F.lit("near"))), TODAY)


@query("q11_notability", """WITH p AS (SELECT item_id, count(DISTINCT vendor_id) AS vendors, sum(quantity) AS sold FROM sale_lines WHERE item_id IS NOT NULL GROUP BY 1),
    e AS (SELECT i.item_id, kind, CASE WHEN i.item_id % 9 > 0 THEN sold % 500 END AS popularity, coalesce(vendors, 0) AS vendors FROM items i LEFT JOIN p USING (item_id)),
    w AS (SELECT *, count(popularity) OVER (PARTITION BY kind) AS n, count(popularity) OVER (PARTITION BY kind ORDER BY popularity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
    SELECT item_id, round(CAST(greatest(vendors - 1, 0) + CASE WHEN popularity IS NULL OR kind IS NULL OR n < 2 THEN 0 ELSE (upto - 1) / (n - 1) END AS DOUBLE), 9) AS score FROM w""")
def notability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item by the vendors that sell it and the place of its sales in its kind."""
    lines = table(spark, sf_dir, "sale_lines").where("item_id is not null").groupBy("item_id").agg(F.count_distinct("vendor_id").alias("n_sources"), F.sum("quantity").alias("sold"))
    items = table(spark, sf_dir, "items").select("item_id", "kind").join(lines, "item_id", "left")
    rows = items.select("item_id", "kind", F.when(F.col("item_id") % 9 > 0, F.col("sold") % 500).alias("popularity"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    return ranking.notability(rows, "kind", "popularity").select("item_id", F.round(F.col("score").cast("double"), 9).alias("score"))
