"""The scalar functions over whole tables: texts are rendered from the columns of every row, and the SQL works out from the
same columns what must come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, geo, hours, nested, text
from ..functions.geo import CITIES
from ..operators import state
from .registry import query, table


def _both(sql: str) -> str:
    """An expression for Spark out of one for DuckDB."""
    return sql.replace("VARCHAR", "STRING").replace("//", "div")


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- orders as days ---------------------------------------------------------------------------------------------------

ZONE = "':00+08:00'"
ORDER_DAYS = "o AS (SELECT o_orderkey, o_orderkey % 8 AS form, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)), '%Y-%m-%d') AS e, lpad(CAST(o_custkey % 12 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS a FROM orders)"


@query("f16_order_ranges", f"""WITH {ORDER_DAYS} SELECT o_orderkey, CASE WHEN form = 7 THEN NULL WHEN form IN (2, 4, 5) THEN d || 'T' || a || {ZONE} ELSE d END AS start,
    CASE WHEN form IN (0, 6) THEN e WHEN form IN (2, 5) THEN d || 'T23:30' || {ZONE} WHEN form = 4 THEN e || 'T23:30' || {ZONE} END AS finish FROM o""")
def order_ranges(spark, sf_dir):
    """Eight ways to write when an order was open: days, the Republic's years, clocks of one day, of every day, and clocks alone."""
    d, e = F.col("o_orderdate"), F.date_add("o_orderdate", (F.col("o_orderkey") % 30).cast("int"))
    a = F.concat(F.lpad((F.col("o_custkey") % 12).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    forms = [
        F.concat(F.date_format(d, "yyyy/M/d"), F.lit(" ～ "), iso(e)), F.concat((F.year(d) - 1911).cast("string"), F.date_format(d, ".M.dd")), F.concat(iso(d), F.lit("（六） "), a, F.lit("-23:30")),
        F.date_format(d, "yyyy年M月d日起"), F.concat(iso(d), F.lit(" - "), iso(e), F.lit(" "), a, F.lit(" ~ 23:30")), F.concat(a, F.lit("至23:30")), F.concat(F.date_format(d, "yyyyMMdd"), F.lit("至"), F.date_format(e, "yyyy.MM.dd")), F.lit("未定"),
    ]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int")).alias("said"), iso(d).alias("base"))
    r = dates.parse_date_range(F.col("said"), F.col("base"))
    return rows.select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.start.value").alias("start"), F.col("r.end.value").alias("finish"))


@query("f15_event_clocks", """WITH e AS (SELECT event_id, user_id % 25 AS h, event_id % 61 AS mi, event_id % 5 AS form FROM events)
    SELECT event_id, CASE WHEN h <= 23 AND (form <> 0 OR mi <= 59) AND form < 4 THEN h END AS h, CASE WHEN h <= 23 AND (form <> 0 OR mi <= 59) AND form < 4 THEN CASE form WHEN 3 THEN 0 ELSE mi END END AS mi FROM e""")
def event_clocks(spark, sf_dir):
    h, mi = (F.col("user_id") % 25).cast("string"), (F.col("event_id") % 61).cast("string")
    two = lambda c: F.lpad(c, 2, "0")
    forms = F.array(F.concat(h, F.lit("："), two(mi)), F.concat(two(h), two(mi), F.lit("59")), F.concat(h, F.lit(" 點 "), mi, F.lit("分")), F.concat(h, F.lit("點")), F.concat(two(h), two(mi)))
    t = dates.parse_time_of_day(F.get(forms, (F.col("event_id") % 5).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", F.col("t.h").cast("long").alias("h"), F.col("t.mi").cast("long").alias("mi"))


@query("f17_event_sentinels", """WITH e AS (SELECT event_id, user_id % 4 AS h, event_id % 5 AS form FROM events) SELECT event_id, CASE form WHEN 0 THEN h = 0 WHEN 1 THEN true WHEN 2 THEN h = 0 ELSE false END AS sentinel FROM e""")
def event_sentinels(spark, sf_dir):
    start = F.concat(F.lit("0"), (F.col("user_id") % 4).cast("string"), F.lit(":00"))
    end = F.get(F.array(F.lit("23:59"), start, F.lit("24:00"), F.lit("12:30"), F.lit(None).cast("string")), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", dates.is_sentinel_range(start, end).alias("sentinel"))


# --- customers as places ----------------------------------------------------------------------------------------------

CITY = f"{_listed(CITIES)}[CAST(c_custkey % 22 AS INTEGER) + 1]"
RAW = f"CASE c_custkey % 5 WHEN 0 THEN replace({CITY}, '臺', '台') || '中正區民生路' || c_custkey || '號' WHEN 1 THEN '104 ' || {CITY} || '中山區' WHEN 2 THEN {CITY} WHEN 3 THEN c_name WHEN 4 THEN '民生路' || c_custkey || '號' END"
HINT = f"CASE WHEN c_custkey % 5 = 4 THEN {CITY} END"


def _spark_list(sql: str) -> str:
    return _both(sql).replace(_listed(CITIES), "array(" + _listed(CITIES)[1:-1] + ")").replace("[CAST(c_custkey % 22 AS INTEGER) + 1]", "[CAST(c_custkey % 22 AS INT)]")


@query("f08_customer_cities", f"SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN {CITY} END AS city FROM customer")
def customer_cities(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", geo.normalize_city(F.expr(_spark_list(RAW))).alias("city"))


@query("f09_customer_addresses", f"""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 3 THEN {CITY} END AS city, CASE c_custkey % 5 WHEN 0 THEN '中正區' WHEN 1 THEN '中山區' END AS district,
    CASE c_custkey % 5 WHEN 0 THEN 'street' WHEN 1 THEN 'district' WHEN 2 THEN 'city' WHEN 3 THEN 'venue-name-only' ELSE 'street' END AS precision FROM customer""")
def customer_addresses(spark, sf_dir):
    parse = geo.address_parser()
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_spark_list(RAW)).alias("raw"), F.expr(_spark_list(HINT)).alias("hint"))
    found = rows.select("c_custkey", parse(F.col("raw"), F.col("hint"), F.lit(None).cast("string")).alias("p"))
    return found.select("c_custkey", "p.city", "p.district", "p.precision")


@query("f06_house_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN '臺北市中山路' || c_custkey % 10 || '段' || CASE WHEN c_custkey % 4 = 1 THEN c_custkey || '之2' ELSE CAST(c_custkey AS VARCHAR) END || '號' END AS house FROM customer")
def house_numbers(spark, sf_dir):
    """Chinese numerals, quarters, floors and signs around house numbers."""
    han = F.get(F.array(*map(F.lit, "〇一二三四五六七八九")), (F.col("c_custkey") % 10).cast("int"))
    key = F.col("c_custkey").cast("string")
    forms = F.array(
        F.concat(F.lit("台北市中山路"), han, F.lit("段"), key, F.lit("號三樓")), F.concat(F.lit("臺北市 中山路"), (F.col("c_custkey") % 10).cast("string"), F.lit("段，"), key, F.lit("之２號")),
        F.concat(F.lit("台北市3鄰中山路"), han, F.lit("段"), key, F.lit("號(近公園)")), F.concat(F.lit("臺北市中山路"), han, F.lit("段")))
    return table(spark, sf_dir, "customer").select("c_custkey", geo.norm_address(F.get(forms, (F.col("c_custkey") % 4).cast("int"))).alias("house"))


@query("f05_identity_keys", f"SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN substr({CITY}, 1, 2) || substr({CITY}, 3, 1) || '立' ELSE '' END || lower(replace(c_name, '#', '')) AS key FROM customer")
def identity_keys(spark, sf_dir):
    """Cities and owners in front of the same names, with signs between; a city's own house keeps its city."""
    name = _spark_list(f"CASE c_custkey % 4 WHEN 0 THEN {CITY} || c_name WHEN 1 THEN replace({CITY}, '臺', '台') || ' 私立-' || c_name WHEN 2 THEN '國立' || c_name ELSE {CITY} || '立' || c_name END")
    return table(spark, sf_dir, "customer").select("c_custkey", geo.venue_identity_key(F.expr(name)).alias("key"))


@query("f04_venue_names", "SELECT s_suppkey, lower(s_name) || CASE WHEN s_suppkey % 3 = 1 THEN 'a廳' ELSE '' END AS name FROM supplier")
def venue_names(spark, sf_dir):
    forms = F.array(F.concat(F.lit("國立"), F.col("s_name")), F.concat(F.lit("市立 "), F.col("s_name"), F.lit("（Ａ廳）")), F.concat(F.lit("​ "), F.col("s_name"), F.lit("—()")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.norm_venue(F.get(forms, (F.col("s_suppkey") % 3).cast("int"))).alias("name"))


# --- coordinates ------------------------------------------------------------------------------------------------------

X, Y = "CAST(118.5 + vec_id % 400 * 0.01 AS DOUBLE)", "CAST(21.5 + vec_id % 500 * 0.01 AS DOUBLE)"


@query("f10_vector_points", f"SELECT vec_id, CASE WHEN vec_id % 4 < 2 THEN round({Y}, 2) END AS lat, CASE WHEN vec_id % 4 < 2 THEN round({X}, 2) END AS lng FROM embeddings")
def vector_points(spark, sf_dir):
    """Points as text, in either order, far away, or not numbers."""
    x, y = F.round(F.expr(X), 2).cast("string"), F.round(F.expr(Y), 2).cast("string")
    form = (F.col("vec_id") % 4).cast("int")
    a = F.get(F.array(y, x, F.lit("0"), F.lit("北緯")), form)
    b = F.get(F.array(x, y, x, x), form)
    return table(spark, sf_dir, "embeddings").select("vec_id", geo.lat_lng(a, b).alias("p")).select("vec_id", "p.lat", "p.lng")


@query("f11_projected_points", "SELECT vec_id, CAST(121 AS DOUBLE) AS lng, true AS north FROM embeddings")
def projected_points(spark, sf_dir):
    """Points on the central meridian keep its longitude, and a greater northing is a greater latitude."""
    at = lambda more: geo.tm2_to_wgs84(F.lit(250_000.0), F.lit(2_500_000.0) + (F.col("vec_id") % 300_000) + more)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("a"), at(1).alias("b"))
    return rows.select("vec_id", F.round("a.lng", 9).alias("lng"), (F.col("b.lat") > F.col("a.lat")).alias("north"))


# --- urls, ids, people, phones ---------------------------------------------------------------------------------------------

PAGE = r"p AS (SELECT page_id, page_id % 5 AS form, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(url, '^https?://[^/?#]+', '') AS rest FROM pages)"


@query("f13_page_urls", f"WITH {PAGE} SELECT page_id, CASE form WHEN 4 THEN NULL WHEN 3 THEN 'https://www.' ELSE CASE form WHEN 2 THEN 'http' ELSE scheme END || '://' END || lower(host) || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS url FROM p")
def page_urls(spark, sf_dir):
    """Every page's address as it is, in capitals, without its colon, without its scheme, and with another scheme."""
    scheme, host, rest = F.regexp_extract("url", "^(https?)://", 1), F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_replace("url", "^https?://[^/?#]+", "")
    forms = F.array(F.col("url"), F.concat(F.lit(" "), F.upper(scheme), F.lit("://"), F.upper(host), rest), F.concat(F.lit("http//"), host, rest), F.concat(F.lit("www."), host, rest), F.concat(F.lit("ftp://"), host, rest))
    return table(spark, sf_dir, "pages").select("page_id", text.norm_url(F.get(forms, (F.col("page_id") % 5).cast("int"))).alias("url"))


@query("f18_order_tickets", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 5 THEN CAST(o_custkey AS VARCHAR) END AS opentix, CASE o_orderkey % 6 WHEN 1 THEN 'e-' || o_orderkey WHEN 5 THEN 'x' END AS kktix, CASE o_orderkey % 6 WHEN 2 THEN 'P' || o_orderkey END AS eratickets, CASE o_orderkey % 6 WHEN 3 THEN 'U' || o_orderkey END AS udnfunlife FROM orders")
def order_tickets(spark, sf_dir):
    """Ids of the four platforms, alone or among other words."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    forms = F.array(
        F.concat(F.lit("購票 https://www.OPENTIX.life/event/"), key, F.lit("。")), F.concat(F.lit("https://org.kktix.cc/events/e-"), key), F.concat(F.lit("https://kham.com.tw/app?a=1&PRODUCT_ID=P"), key, F.lit("&b=2")),
        F.concat(F.lit("http://udnfunlife.com/show?pid=U"), key), F.concat(F.lit("https://example.org/event/"), key), F.concat(F.lit("https://opentix.life/program/"), cust, F.lit(" https://a.kktix.cc/events/x")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.external_ids(F.get(forms, (F.col("o_orderkey") % 6).cast("int"))).alias("ids"))
    return rows.select("o_orderkey", *(F.col("ids")[n].alias(n) for n in ("opentix", "kktix", "eratickets", "udnfunlife")))


@query("f20_client_performers", "SELECT client_id, CASE client_id % 3 WHEN 0 THEN '(' || city || ')' || name || '|(' || city || ')b' || client_id || '|(x)c' WHEN 1 THEN name || '|d' || client_id ELSE '' END AS shown FROM (SELECT client_id, coalesce(name, '某人') AS name, coalesce(city, '某地') AS city FROM clients)")
def client_performers(spark, sf_dir):
    """Clients as performers of their city, in one text."""
    rows = table(spark, sf_dir, "clients").select("client_id", F.coalesce("name", F.lit("某人")).alias("name"), F.coalesce("city", F.lit("某地")).alias("city"))
    key = F.col("client_id").cast("string")
    forms = F.array(F.concat(F.lit("（"), F.col("city"), F.lit("）"), F.col("name"), F.lit("/ b"), key, F.lit("(x) c")), F.concat(F.col("name"), F.lit("、 d"), key), F.lit(" "))
    found = text.split_performers(F.get(forms, (F.col("client_id") % 3).cast("int")))
    shown = F.transform(found, lambda p: F.concat(F.when(p["country"].isNotNull(), F.concat(F.lit("("), p["country"], F.lit(")"))).otherwise(""), p["name_raw"]))
    return rows.select("client_id", F.array_join(shown, "|").alias("shown"))


@query("f34_client_phones", "SELECT client_id, CASE client_id % 4 WHEN 0 THEN '02-' || (20000000 + client_id) WHEN 1 THEN NULL WHEN 2 THEN '04-' || (2000000 + client_id) || '#12' ELSE '03-' || (300000 + client_id) END AS phone FROM clients")
def client_phones(spark, sf_dir):
    """Office numbers beside mobile ones, before, behind and alone."""
    k = F.col("client_id")
    mobile = F.concat(F.lit("09"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((k * 7 % 1000).cast("string"), 3, "0"))
    forms = F.array(F.concat(F.lit("02-"), (k + 20_000_000).cast("string"), F.lit("、"), mobile), mobile, F.concat(mobile, F.lit("/04-"), (k + 2_000_000).cast("string"), F.lit("#12")), F.concat(F.lit("03-"), (k + 300_000).cast("string"), F.lit("或"), F.replace(mobile, F.lit("-"), F.lit(" "))))
    return table(spark, sf_dir, "clients").select("client_id", text.redact_phone(F.get(forms, (k % 4).cast("int"))).alias("phone"))


# --- titles, hours, frequencies ------------------------------------------------------------------------------------------------


@query("f02_part_titles", """WITH t AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS n, p_partkey % 4 AS form, lower(replace(p_type, ' ', '')) AS y FROM part)
    SELECT p_partkey, CASE form WHEN 0 THEN 'exact' WHEN 1 THEN CASE WHEN length(n) >= 4 THEN 'contains' END WHEN 2 THEN CASE WHEN n = y THEN 'exact' WHEN (contains(n, y) AND length(y) >= 4) OR (contains(y, n) AND length(n) >= 4) THEN 'contains' END END AS similar FROM t""")
def part_titles(spark, sf_dir):
    """Names against themselves in another dress, within a longer title, against the kind, and against nothing."""
    n = F.col("p_name")
    other = F.array(F.concat(F.lit("２０２４年度【系列】《"), F.upper(n), F.lit("》!")), F.concat(F.lit("夏日 "), n, F.lit("：特輯")), F.col("p_type"), F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.norm_title(n).alias("a"), text.norm_title(F.get(other, (F.col("p_partkey") % 4).cast("int"))).alias("b"))
    return rows.select("p_partkey", text.title_similar(F.col("a"), F.col("b")).alias("similar"))


@query("f23_supplier_hours", """WITH s AS (SELECT s_suppkey, lpad(CAST(7 + s_suppkey % 4 AS VARCHAR), 2, '0') || ':30' AS a, lpad(CAST(16 + s_suppkey % 5 AS VARCHAR), 2, '0') || ':00' AS b FROM supplier)
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Tu+We+Th+Fr+Sa+Su ' || a || '-' || b WHEN 1 THEN 'Mo+Tu+We+Th+Fr ' || a || '-' || b ELSE '' END AS shown FROM s""")
def supplier_hours(spark, sf_dir):
    a, b = F.concat(F.lpad((F.col("s_suppkey") % 4 + 7).cast("string"), 2, "0"), F.lit(":30")), F.concat((F.col("s_suppkey") % 5 + 16).cast("string"), F.lit(":00"))
    forms = F.array(F.concat(F.lit("1.週二至週日:"), a, F.lit("-"), b, F.lit("\n2.週一休館")), F.concat(F.lit("週一至週五 "), a, F.lit("~"), b), F.concat(a, F.lit("-"), b))
    found = hours.parse_opening_hours(F.get(forms, (F.col("s_suppkey") % 3).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("h")).select("s_suppkey", F.coalesce(_shown(F.col("h")), F.lit("")).alias("shown"))


def _shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda g: F.concat(F.array_join(F.transform(g["days"], lambda d: F.substring(d, 1, 2)), "+"), F.lit(" "), g["opens"], F.lit("-"), g["closes"])), ";")


SAID = ["daily", "irregular", "monthly", "yearly", "undeclared", "undeclared"]


@query("f28_client_frequencies", f"SELECT client_id, {_listed(SAID)}[CAST(client_id % 6 AS INTEGER) + 1] AS bucket FROM clients")
def client_frequencies(spark, sf_dir):
    """Frequencies with the client's number in them."""
    return table(spark, sf_dir, "clients").select("client_id", state.freq_bucket(_said()).alias("bucket"))


def _said() -> Column:
    k = (F.col("client_id") % 28 + 1).cast("string")
    forms = F.array(F.concat(F.lit("每日"), k, F.lit("時")), F.concat(F.lit("不定期（約每"), k, F.lit("年）")), F.concat(F.lit("每 "), k, F.lit(" 月")), F.concat(k, F.lit(" 年")), F.concat(F.lit("Unverified "), k), k)
    return F.get(forms, (F.col("client_id") % 6).cast("int"))


HOURS = {"event": [3, 6, 72, 168, 6, 6], "directory": [24, 24, 168, 336, 24, 24]}


@query("x07_client_schedule", f"SELECT client_id, CAST(CASE WHEN source = 'crm' THEN {HOURS['event']} ELSE {HOURS['directory']} END[CAST(client_id % 6 AS INTEGER) + 1] AS BIGINT) * 3600000 AS interval_ms FROM clients")
def client_schedule(spark, sf_dir):
    """The time between fetches by the frequency that each client states, for events and for directories."""
    entity = F.when(F.col("source") == "crm", "event").otherwise("venue")
    rows = table(spark, sf_dir, "clients").select("client_id", _said().alias("said"), entity.alias("entity"))
    return rows.select("client_id", state.scheduled(state.freq_bucket(F.col("said")), F.col("entity"))["interval_ms"].cast("long").alias("interval_ms"))


@query("m14_nested_payloads", """SELECT client_id, nullif(trim(name), '') AS name, CASE WHEN client_id % 2 = 0 THEN '02-' || (20000000 + client_id) END AS phone, CASE WHEN client_id % 3 > 0 THEN email END AS email, 'https://x.org/0912345678' AS source_url,
    CASE WHEN client_id % 4 < 3 THEN 'ask, room ' || client_id END AS first_note, CASE client_id % 4 WHEN 0 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS n_notes, CASE WHEN city IS NOT NULL THEN 'no. 第0942400665號' END AS remark FROM clients""")
def nested_payloads(spark, sf_dir):
    """A payload with sessions, notes and remarks for every client, some of them empty, redacted and compacted at every depth."""
    k = F.col("client_id")
    mobile = F.concat(F.lit("0912-345-"), F.lpad((k % 1000).cast("string"), 3, "0"))
    note = F.when(k % 4 == 0, F.array(F.concat(F.lit("ask "), mobile, F.lit(", room "), k.cast("string")), F.lit("call me"), F.concat(F.lit("  "), mobile))).when(k % 4 < 3, F.array(F.lit(" "), F.concat(F.lit("ask"), F.lit(", room "), k.cast("string")))).otherwise(F.array(mobile, F.lit("")))
    records = table(spark, sf_dir, "clients").select(
        "client_id", "name", F.when(k % 2 == 0, F.concat(F.lit("02-"), (k + 20_000_000).cast("string"), F.lit("、"), mobile)).otherwise(mobile).alias("phone"), F.when(k % 3 > 0, F.col("email")).otherwise("a@gmail.com").alias("email"),
        F.lit("https://x.org/0912345678").alias("sourceUrl"), k.cast("string").alias("licenseNo"), F.struct(F.transform(note, lambda x: F.struct(x.alias("description"))).alias("sessions"), F.create_map(F.lit("remark"), F.when(F.col("city").isNotNull(), "no. 第0942400665號").otherwise(mobile)).alias("extra")).alias("more"))
    clean = nested.redacted(records)
    notes = F.col("more.sessions.description")
    return clean.select("client_id", "name", "phone", "email", F.col("sourceUrl").alias("source_url"), F.replace(notes[0], F.lit("ask ,"), F.lit("ask,")).alias("first_note"), F.size(F.col("more.sessions")).alias("n_notes"), F.col("more.extra")["remark"].alias("remark"))


POINTS_OF_CLIENTS = f"""SELECT client_id, ['A', 'D', 'N', 'H'][CAST(client_id % 4 AS INTEGER) + 1] AS t, {_listed(CITIES)}[CAST(client_id % 22 AS INTEGER) + 1] AS c, nullif(trim(name), '') AS name, client_id % 3 AS form FROM clients"""


@query("s11_map_points", f"""WITH p AS ({POINTS_OF_CLIENTS}) SELECT 'moc-emap-poi:' || t || '-' || client_id AS id, CASE t WHEN 'A' THEN 'heritage' WHEN 'D' THEN 'organization' ELSE 'venue' END AS entity_kind, name,
    CASE WHEN client_id % 5 = 0 THEN '自訂' ELSE ['文化資產', '社區', '工藝工作室', '博物館'][CAST(client_id % 4 AS INTEGER) + 1] END AS category_raw, c AS city, CASE form WHEN 2 THEN 'city' ELSE 'street' END AS address_precision,
    CAST(CASE WHEN form < 2 THEN 23.5 END AS DOUBLE) AS lat, CAST(CASE WHEN form < 2 THEN 120.5 END AS DOUBLE) AS lng FROM p""")
def map_points(spark, sf_dir):
    """A point of the culture map for every client: addresses with and without their city, coordinates in either order or far away."""
    from ..sources import mappings

    k = F.col("client_id")
    city = F.get(F.array(*map(F.lit, CITIES)), (k % 22).cast("int"))
    form = (k % 3).cast("int")
    road = F.concat(F.lit("民生路"), k.cast("string"), F.lit("號"))
    bronze = table(spark, sf_dir, "clients").select(
        F.get(F.array(*map(F.lit, "ADNH")), (k % 4).cast("int")).alias("_typeId"), k.cast("string").alias("mainTypePk"), "name", F.lit(" ").alias("intro"), F.lit("").alias("representImage"), F.when(k % 5 == 0, "自訂").otherwise("").alias("groupTypeName"),
        F.when(form == 1, "").otherwise(city).alias("cityName"), F.get(F.array(road, F.concat(city, road), F.lit("")), form).alias("address"), F.get(F.array(F.lit("23.5"), F.lit("120.5"), F.lit("35.9")), form).alias("latitude"), F.get(F.array(F.lit("120.5"), F.lit("23.5"), F.lit("0")), form).alias("longitude"),
        *[F.lit(None).cast("string").alias(c) for c in ("openTime", "phone", "email", "website", "srcWebsite")], F.lit(None).cast("double").alias("hitRate"))
    found = mappings.observations("moc-emap-poi", bronze, F.lit("2024-06-01").cast("date"))
    return found.select("id", "entity_kind", "name", "category_raw", "city", "address_precision", "lat", "lng")
