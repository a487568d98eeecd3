"""Names and places on the shop's clients: containment, heritage sites and the whole cascade of resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import containment, matching, resolution
from .registry import query, table

#: A client as a place: those of the central system are heritage sites, those of other sources venues. Names, districts and
#: coordinates come from the columns; a fifth of the rows has no coordinates.
LAT = "CASE WHEN client_id % 5 > 0 THEN 23 + nation_id * 0.05 + (master_id % 7) * 0.001 + (client_id % 3) * 0.002 END"
PLACE = f"CAST(nation_id AS VARCHAR) AS city, city AS district, CAST({LAT} AS DOUBLE) AS lat, CAST(CASE WHEN ({LAT}) IS NOT NULL THEN 121.0 END AS DOUBLE) AS lng"
HERITAGE = "CASE WHEN client_id % 3 = 0 THEN name || '（' || city || '舊址）' WHEN client_id % 7 = 0 THEN name || '(一級)' ELSE name END"
VENUE = "CASE client_id % 4 WHEN 0 THEN name WHEN 1 THEN '國定古蹟' || name WHEN 2 THEN name || '文物館' ELSE '國立' || name || '(' || coalesce(city, '') || ')' END"


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING")


def _norm(name: str) -> str:
    return f"lower(regexp_replace(regexp_replace(coalesce({name}, ''), '[\\s\\-–—_()（）]', '', 'g'), '^(國立|市立|縣立|私立)', ''))"


METRES = "CASE WHEN v.lat IS NOT NULL AND h.lat IS NOT NULL THEN round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(v.lat - h.lat) / 2), 2) + cos(radians(h.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lng - h.lng) / 2), 2))))) END"

SITES = f"""WITH h AS (SELECT CAST(client_id AS VARCHAR) AS id, {HERITAGE} AS name, {PLACE} FROM clients WHERE source = 'crm'),
links AS (SELECT DISTINCT CAST(master_id AS VARCHAR) AS h, CAST(client_id AS VARCHAR) AS v FROM clients WHERE client_id % 6 = 0 AND source <> 'crm' AND CAST(master_id AS VARCHAR) IN (SELECT id FROM h)),
rejects AS (SELECT CAST(master_id AS VARCHAR) AS h, CAST(client_id AS VARCHAR) AS v FROM clients WHERE client_id % 10 = 3),
v AS (SELECT CAST(client_id AS VARCHAR) AS id, {_norm(VENUE)} AS vn, {PLACE} FROM clients WHERE source <> 'crm' AND CAST(client_id AS VARCHAR) NOT IN (SELECT v FROM links)),
vs AS (SELECT *, regexp_replace(vn, '^(國定|直轄市定|市定|縣市定|縣定)?古蹟|^(歷史|紀念)建築', '') AS bare FROM v WHERE vn <> ''),
parts AS (SELECT id, name AS part, 3 AS least FROM h UNION ALL SELECT id, regexp_replace(name, '[（(][^）)]*[）)]', '', 'g'), 3 FROM h UNION ALL SELECT id, unnest(regexp_extract_all(name, '[（(]([^）)]+)[）)]', 1)), 4 FROM h),
keys AS (SELECT DISTINCT id, {_norm("part")} AS key FROM parts WHERE length({_norm("part")}) >= least),
pairs AS (SELECT v.id AS vid, h.id AS hid, length(key) AS size, CAST({METRES} AS BIGINT) AS metres, v.vn = key OR v.bare = key AS same, h.district = v.district AS near
    FROM vs v JOIN keys ON contains(v.vn, key) OR v.bare = key JOIN h ON h.id = keys.id WHERE (h.city = v.city OR h.city IS NULL OR v.city IS NULL)
    AND NOT EXISTS (SELECT 1 FROM rejects r WHERE r.h = h.id AND r.v = v.id)),
ranked AS (SELECT *, CASE WHEN same THEN CASE WHEN coalesce(metres, 0) <= 1000 THEN 2 END WHEN size >= 4 AND CASE WHEN metres IS NULL THEN near AND size >= 5 ELSE metres <= 300 END THEN 1 END AS rank FROM pairs),
levels AS (SELECT vid, rank, size, min(hid) AS hid, count(DISTINCT hid) AS n, min(metres) AS metres, row_number() OVER (PARTITION BY vid ORDER BY rank DESC, size DESC) AS r FROM ranked WHERE rank IS NOT NULL GROUP BY vid, rank, size)
SELECT hid AS heritage_id, vid AS venue_id, CASE rank WHEN 2 THEN 'exact-name' ELSE 'name-contains' END AS method, CAST(CASE rank WHEN 2 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence, metres FROM levels WHERE r = 1 AND n = 1
UNION ALL SELECT h, v, 'manual', CAST(1.0 AS DOUBLE), NULL FROM links"""


@query("j11_heritage_sites", SITES)
def heritage_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of all other sources against those of the central system."""
    clients = table(spark, sf_dir, "clients")
    columns = _spark(PLACE).split(", ")

    def rows(name: str) -> DataFrame:
        return clients.selectExpr("client_id as id", f"{_spark(name)} as name", "source", *columns)

    decided = lambda rule: clients.where(rule).selectExpr("master_id as heritage_id", "client_id as venue_id")
    return containment.heritage_sites(rows(HERITAGE).where("source = 'crm'"), rows(VENUE).where("source <> 'crm'"), decided("client_id % 10 = 3"), decided("client_id % 6 = 0 and source <> 'crm'"))


@query("g15_whole_cascade")
def whole_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale names the place of its client; the registry is made of the central system's clients.

    One walk in order is beyond SQL; tests compare the operator with such a walk.
    """
    columns = _spark(PLACE).split(", ")
    address = "CASE WHEN client_id % 3 < 2 THEN city || '路' || (master_id % 20) || '號' END as address"
    precision = "CASE WHEN client_id % 2 = 0 THEN 'street' END as precision"
    clients = table(spark, sf_dir, "clients")
    registry = clients.where("source = 'crm'").selectExpr("client_id as id", "client_id as ord", f"{_spark(HERITAGE)} as name", *columns, address, precision, "client_id % 3 as sources")
    places = clients.where("source <> 'crm'").selectExpr("client_id", f"{_spark(VENUE)} as name", *columns, address, precision)
    sessions = table(spark, sf_dir, "sales").selectExpr("client_id", "sale_id as position").join(places, "client_id").drop("client_id")
    aliases = clients.where("client_id % 40 = 3").selectExpr(f"{_spark(VENUE)} as alias", "name as target")
    rejected = clients.where("client_id % 50 = 7").selectExpr(f"{_spark(VENUE)} as name")
    spellings = clients.where("source = 'crm' and client_id % 9 = 0").selectExpr("client_id as id", "city || name as name")
    found = resolution.resolve(sessions, registry, spellings, aliases, rejected)
    return found.select("key", "sessions", "place", "state", "method", "confidence")


#: Clients as records whose true identity is their master: events or venues, where and when their row says.
RECORDS = f"""SELECT source, CASE WHEN master_id % 2 = 0 THEN 'event' ELSE 'venue' END AS kind, name, CAST(epoch(updated_at) AS BIGINT) // 86400 AS start_day, CAST(epoch(updated_at) AS BIGINT) // 86400 + 40 AS end_day,
    city, segment, CAST({LAT} AS DOUBLE) AS lat, CAST(CASE WHEN ({LAT}) IS NOT NULL THEN 121.0 END AS DOUBLE) AS lng, master_id FROM clients"""
TITLE = "lower(regexp_replace(coalesce({}, ''), '[^0-9A-Za-zÀ-ÿ]', '', 'g'))"
MEANING = "length(regexp_replace({}, '[^a-z]', '', 'g'))"

REMATCH = f"""WITH r AS ({RECORDS}), c AS (SELECT *, {TITLE.format("name")} AS t FROM r WHERE source IS NOT NULL),
p AS (SELECT a.source AS "left", b.source AS "right", a.kind, a.t = b.t AS same, CASE WHEN a.t = b.t THEN CASE WHEN a.t <> '' AND {MEANING.format("a.t")} >= 2 THEN 'exact' END
        WHEN contains(a.t, b.t) AND length(b.t) >= 4 AND {MEANING.format("b.t")} >= 4 THEN 'contains' WHEN contains(b.t, a.t) AND length(a.t) >= 4 AND {MEANING.format("a.t")} >= 4 THEN 'contains' END AS alike,
        a.lat IS NOT NULL AND b.lat IS NOT NULL AS located, {METRES.replace("v.", "b.").replace("h.", "a.").replace("round(", "(", 1)} AS metres, coalesce(a.city = b.city, false) AS city,
        coalesce(a.start_day <= b.end_day AND b.start_day <= a.end_day, false) AS meets, coalesce(a.segment = b.segment OR (length(a.segment) >= 3 AND length(b.segment) >= 3 AND (contains(a.segment, b.segment) OR contains(b.segment, a.segment))), false) AS venue
      FROM c a JOIN c b ON a.master_id = b.master_id AND a.source < b.source)
SELECT "left", "right", kind, count(*) AS pairs, CAST(count(*) FILTER (same) AS BIGINT) AS same_title, CAST(count(*) FILTER (CASE WHEN alike IS NULL THEN false
    WHEN kind = 'event' THEN meets AND (venue OR (located AND metres < 500)) WHEN alike = 'contains' THEN false WHEN located THEN metres <= 100 ELSE city END) AS BIGINT) AS auto FROM p GROUP BY ALL"""


@query("g17_strip_and_rematch", REMATCH)
def strip_and_rematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of clients of one master the rules join without knowing the master."""
    days = "floor(unix_seconds(cast(updated_at as timestamp)) / 86400)"
    rows = table(spark, sf_dir, "clients").selectExpr(
        "source", "case when master_id % 2 = 0 then 'event' else 'venue' end as kind", "name", "1 as norm_name_count", "array_compact(array(city)) as city", "array_compact(array(segment)) as venue",
        f"{days} as start_day", f"{days} + 40 as end_day", f"cast({LAT} as double) as lat", f"cast(case when ({LAT}) is not null then 121.0 end as double) as lng", "map('master', cast(master_id as string)) as external")
    return matching.strip_and_rematch(rows.withColumn("variants", text.title_variants(F.col("name"))))
