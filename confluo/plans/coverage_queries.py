"""Row rules, relation rules, state rules and format round trips on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..operators.storage import shared_dir
from ..operators import calendar, discovery, fusion, relations, spatial, state
from ..sources import readers
from .calendar_queries import SESSIONS, TODAY, sessions
from .registry import query, table

DATE = "DATE '2024-02-01'"


def _date(day: str = "2024-02-01") -> F.Column:
    return F.lit(day).cast("date")


# --- S: formats, written to the shared folder and read back ---------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_ndjson_round_trip", "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS chars FROM conversations")
def ndjson(spark, sf_dir):
    path = _folder(spark, "ndjson")
    table(spark, sf_dir, "conversations").write.json(path)
    return readers.read_ndjson(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("s02_missing_file", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def missing(spark, sf_dir):
    """Customers kept as JSON, read together with a store that is not there yet."""
    folder = _folder(spark, "kept")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).write.json(folder)
    kept = readers.read_or_empty(spark, folder, "id long, segment string")
    return kept.unionByName(readers.read_or_empty(spark, _folder(spark, "missing"), "id long, segment string"))


@query("s03_byte_order_marks", "SELECT item_id, CAST(length(text) AS BIGINT) AS chars FROM benchmark")
def byte_order_marks(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.regexp_replace(F.to_json(F.struct("item_id", "text")), '"text"', '"﻿text"').alias("j"))
    read = rows.select(F.from_json(readers.without_boms(F.col("j")), "item_id long, text string").alias("r")).select("r.*")
    return read.select("item_id", F.length("text").cast("long").alias("chars"))


@query("s04_csv_round_trip", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars FROM conversations")
def csv(spark, sf_dir):
    path = _folder(spark, "csv")
    table(spark, sf_dir, "conversations").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    rows = readers.read_csv(spark, path, "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("s05_flat_xml", "SELECT c_custkey AS id, c_name AS name FROM customer")
def flat_xml(spark, sf_dir):
    """A feed for every customer, with its items read from it."""
    item = F.concat(F.lit("<rss><item><id>"), F.col("c_custkey").cast("string"), F.lit("</id><name><![CDATA["), F.col("c_name"), F.lit("]]></name></item></rss>"))
    items = table(spark, sf_dir, "customer").select(F.inline(readers.xml_items(item, "item", ["id", "name"])))
    return items.select(F.col("id").cast("long").alias("id"), "name")


@query("s07_html_blocks", "SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)) AS BIGINT) AS links FROM pages")
def html_blocks(spark, sf_dir):
    blocks = readers.html_blocks(F.col("html"), r'(<li><a href="[^"]*">)', {"href": r'href="([^"]*)"'})
    return table(spark, sf_dir, "pages").select("page_id", F.size(blocks).cast("long").alias("links"))


@query("s20_day_partitions", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def day_partitions(spark, sf_dir):
    """Events written by day and counted from the folders."""
    path = _folder(spark, "days")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    rows.repartition("day").write.partitionBy("day").parquet(path)
    return spark.read.schema("event_id long, day date").parquet(path).groupBy("day").agg(F.count("*").alias("n"))


# --- P: row rules -----------------------------------------------------------------------------------------------------------


@query("p02_ended_before", "SELECT l_orderkey, max(l_shipdate) < TIMESTAMP '1997-06-15' AS ended FROM lineitem GROUP BY 1")
def ended_before(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_shipdate") < F.lit("1997-06-15").cast("timestamp_ntz")).alias("ended"))


@query("p03_status", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'cancelled' WHEN value > 50 THEN 'postponed' ELSE 'scheduled' END AS status FROM events")
def status(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "cancelled").when(F.col("value") > 50, "postponed").otherwise("scheduled").alias("status"))


@query("p04_superseded", """WITH m AS (SELECT o_custkey AS cluster, o_orderpriority AS source, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS gone, DATE '1996-01-01' AS last_day FROM orders)
    SELECT o_orderkey FROM m WHERE NOT (gone IS NOT NULL AND gone < last_day AND EXISTS (SELECT 1 FROM m q WHERE q.cluster = m.cluster AND q.source = m.source AND q.gone IS NULL))""")
def superseded(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("source"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("disappeared_at"), F.lit("1996-01-01").cast("date").alias("last_day"))
    return fusion.without_superseded(rows).select("o_orderkey")


@query("p05_partial_cancellation", "WITH m AS (SELECT *, l_returnflag = 'R' AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, bool_and(c) OVER (PARTITION BY l_orderkey, l_suppkey % 2) AS every FROM m) WHERE every OR NOT c")
def partial_cancellation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), (F.col("l_suppkey") % 2).alias("source"), "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("cancelled"))
    return fusion.without_cancelled(rows).select(F.col("cluster").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("p06_label_guard", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN NULL ELSE url END AS label FROM pages")
def label_guard(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.when(~F.rlike("url", F.lit("^https?://")), F.col("url")).alias("label"))


@query("p07_allow_list", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'ECONOMY|SMALL')")
def allow_list(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.rlike("p_type", F.lit("ECONOMY|SMALL"))).select("p_partkey")


@query("p09_page_eligibility", "SELECT source, max(n_chars) AS longest FROM documents GROUP BY 1 HAVING max(n_chars) >= 200")
def page_eligibility(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("longest")).where("longest >= 200")


@query("p11_semi_filter", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def semi_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_semi").select("o_orderkey")


@query("p12_min_impact", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2")
def min_impact(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 2")


# --- J, G: relations --------------------------------------------------------------------------------------------------------


@query("j06_name_head", "SELECT s_suppkey, NULLIF(regexp_extract(s_name, '^(.{2,}?(?:0001|0002))', 1), '') AS head FROM supplier")
def name_head(spark, sf_dir):
    """The head rule with other end words than those of venues."""
    head = F.regexp_extract("s_name", "^(.{2,}?(?:0001|0002))", 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif(head, F.lit("")).alias("head"))


@query("j07_same_place")
def same_place_all(spark, sf_dir):
    """Every row of embeddings; SQL would compare all rows of a key with each other."""
    e, i = F.col("embedding"), F.col("vec_id")
    lat = F.when(i % 3 > 0, 24 + e[0].cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 20).alias("key"), (i % 2).alias("city"), lat.alias("lat"), (121 + e[1].cast("double")).alias("lng"), (i % 7).alias("house"))
    return relations.same_place(rows, rows, 20_000)


@query("j08_suffix_keys", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), r AS (SELECT DISTINCT substr(p_name, position(' ' IN p_name) + 1) AS key FROM part WHERE p_partkey % 3 = 0), s AS (SELECT name, key, length(key) AS l FROM n JOIN r ON ends_with(name, key) AND length(name) - length(key) >= 2 AND length(key) >= 4) SELECT name, arg_max(key, l) AS id FROM s GROUP BY 1")
def suffix_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.col("p_name").alias("key")).distinct()
    registry = part.where("p_partkey % 3 = 0").select(F.substring_index("p_name", " ", -1).alias("key")).distinct().withColumn("id", F.col("key"))
    return relations.by_suffix(names, registry)


@query("j11_one_to_one", """WITH c AS (SELECT p_brand AS l, p_type AS r, min(p_size) AS rank, count(*) AS size FROM part GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER w AS n, lead(rank) OVER w AS nr, lead(size) OVER w AS ns FROM c WINDOW w AS (PARTITION BY l ORDER BY rank, size DESC, r)),
    s AS (SELECT * FROM b WHERE n = 1 AND NOT (nr IS NOT DISTINCT FROM rank AND ns IS NOT DISTINCT FROM size)), t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY rank, size DESC, l) AS m FROM s) SELECT l AS brand, r AS type FROM t WHERE m = 1""")
def one_to_one(spark, sf_dir):
    cand = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("left"), F.col("p_type").alias("right")).agg(F.min("p_size").alias("rank"), F.count("*").alias("size"))
    return relations.one_to_one(cand).select(F.col("left").alias("brand"), F.col("right").alias("type"))


@query("g08_split_by_prefix", """WITH m AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS component, p_name AS name, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part),
    h AS (SELECT id, min(CAST(id AS VARCHAR)) OVER (PARTITION BY component, substr(name, 1, 3)) AS g FROM m WHERE n > 4) SELECT id, g AS component FROM h UNION ALL SELECT id, component FROM m WHERE n <= 4""")
def split_by_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("component"), F.col("p_name").alias("name"))
    split = spatial.split_by_prefix(rows.withColumn("id", F.col("id").cast("string")))  # ids and components of one type
    return split.select(F.col("id").cast("long").alias("id"), F.col("component").cast("string").alias("component"))


@query("g09_group_names")
def group_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    return rows.select("p_brand", "p_size", spatial.building_name(F.col("names")).alias("name"))


@query("g10_manual_merge", "SELECT CASE WHEN n_regionkey = 4 THEN 0 ELSE n_regionkey END AS grp, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS members FROM nation GROUP BY 1")
def manual_merge(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("member"))
    merges = table(spark, sf_dir, "region").where("r_regionkey = 4").select(F.col("r_regionkey").alias("group"), F.lit(0).alias("into"))
    return relations.merged_groups(groups, merges).select(F.col("group").alias("grp"), F.array_join("members", "|").alias("members"))


@query("g12_derived_places", "SELECT o_custkey % 100 AS key, arg_min(o_orderpriority, {'l': length(o_orderpriority), 'n': o_orderpriority}) AS name, count(*) AS sessions FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F' GROUP BY 1")
def derived_places(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("key"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).alias("lat"), F.when(F.col("o_orderstatus") == "F", "a").alias("address"))
    return relations.derived_places(rows)


@query("g13_preferred_names", "WITH n AS (SELECT c_nationkey AS id, c_name AS name, c_custkey % 5 = 0 AS page, c_custkey % 11 AS sessions FROM customer) SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page DESC, sessions DESC, name) AS r FROM n) WHERE r = 1")
def preferred_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("has_page"), (F.col("c_custkey") % 11).alias("sessions"))
    return relations.preferred_names(rows)


@query("a08_conditional_ratio", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS ratio FROM orders GROUP BY 1")
def conditional_ratio(spark, sf_dir):
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(done.alias("done"), F.round(done / F.count("*"), 6).alias("ratio"))


# --- F: scalar functions ------------------------------------------------------------------------------------------------------


@query("f01_norm_title", r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '[.]', '', 'g'), '[\s\-_~!?,:;/\\|+*''\"\[\]()]', '', 'g')) AS title FROM pages")
def norm_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.norm_title(F.col("url")).alias("title"))


@query("f03_slug", r"SELECT s_suppkey, trim(regexp_replace(s_name, '[\s/|,:;!?~''\"*#%&+@=<>.]+', '-', 'g'), '-') AS slug FROM supplier")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.make_slug(F.col("s_name")).alias("slug"))


@query("f12_haversine", "SELECT vec_id, CAST(round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(CAST(embedding[1] AS DOUBLE)) / 2), 2) + cos(radians(24.0)) * cos(radians(24 + CAST(embedding[1] AS DOUBLE))) * pow(sin(radians(CAST(embedding[2] AS DOUBLE)) / 2), 2)))) AS BIGINT) AS metres FROM embeddings")
def haversine(spark, sf_dir):
    e = F.col("embedding")
    d = geo.haversine_m(F.lit(24.0), F.lit(121.0), 24 + e[0].cast("double"), 121 + e[1].cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(d).cast("long").alias("metres"))


@query("f24_day_gap", "SELECT o_orderkey, CAST(date_diff('day', o_orderdate, TIMESTAMP '1998-01-01') AS BIGINT) AS days FROM orders")
def day_gap(spark, sf_dir):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.day_gap(start, F.lit(883_612_800)).alias("days"))


@query("f28_frequency_bucket", """SELECT n_nationkey, ['daily', 'monthly', 'irregular', 'undeclared', 'irregular', 'monthly', 'monthly', 'yearly', 'undeclared', 'daily', 'yearly'][n_nationkey % 11 + 1] AS bucket FROM nation""")
def frequency(spark, sf_dir):
    said = F.array(*map(F.lit, ["每日", "每2月", "不定期更新（每年）", "", "不定期", "每季", "半年", "每1年", "UNVERIFIED 每日", "updated daily", "3 年"]))
    return table(spark, sf_dir, "nation").select("n_nationkey", state.freq_bucket(F.get(said, F.col("n_nationkey") % 11)).alias("bucket"))


@query("x07_schedule", """SELECT n_nationkey, [3, 72, 6, 6, 168][n_nationkey % 5 + 1] * 3600000 * (CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE [8, 7 / 3, 4, 4, 2][n_nationkey % 5 + 1] END) // 1 AS interval_ms FROM nation""")
def schedule(spark, sf_dir):
    bucket = F.get(F.array(*map(F.lit, ["daily", "monthly", "irregular", "undeclared", "yearly"])), F.col("n_nationkey") % 5)
    kind = F.when(F.col("n_regionkey") % 2 == 0, "event").otherwise("venue")
    return table(spark, sf_dir, "nation").select("n_nationkey", state.scheduled(bucket, kind)["interval_ms"].cast("double").alias("interval_ms"))


@query("f29_durations", "SELECT p_partkey, CASE WHEN p_size % 24 = 0 THEN (p_size // 24) || 'd' ELSE p_size || 'h' END AS shown FROM part")
def durations(spark, sf_dir):
    ms = dates.duration_ms(F.concat(F.col("p_size").cast("string"), F.lit("h")))
    return table(spark, sf_dir, "part").select("p_partkey", dates.duration_text(ms).alias("shown"))


@query("f30_series_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'concert' || lower(replace(substr(o_orderpriority, 3), ' ', '')) END AS key FROM orders")
def series_key(spark, sf_dir):
    title = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "2024 ").otherwise(""), F.lit("Concert "), F.substring("o_orderpriority", 3, 20))
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.series_key(title).alias("key"))


@query("f31_fold", "SELECT s_suppkey, lower(replace(s_name, ' ', '')) AS folded FROM supplier")
def folded(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.fold(F.col("s_name")).alias("folded"))


# --- X, Q ---------------------------------------------------------------------------------------------------------------------


@query("x03_recency_gate", """SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN NOT (doc_id % 3 = 0) ELSE NOT (doc_id % 3 = 0) AND NOT (doc_id % 5 = 0) AND NOT (doc_id % 7 = 0) END AS gated FROM documents""")
def recency_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "venue").otherwise("heritage").alias("kind"), (F.col("doc_id") % 7 == 0).alias("visit"))
    return state.recency_gate(pages, pages.where("path % 3 = 0"), pages.where("path % 5 = 0"))


@query("x04_grace_window", "SELECT o_orderkey, d > 60 AND NOT (d <= 180 AND o_custkey % 20 >= 10) AS late FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '1998-01-01') AS d FROM orders)")
def grace(spark, sf_dir):
    late = state.ended_beyond_grace(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date"), F.col("o_custkey") % 20)
    return table(spark, sf_dir, "orders").select("o_orderkey", late.alias("late"))


@query("x06_due_selection", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR (o_orderkey % 3 <> 0 AND o_orderdate <= TIMESTAMP '1996-01-01')")
def due(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 10 == 0).alias("forced"), (k % 3 == 0).alias("skip"), F.col("o_orderdate").alias("next_due"))
    return state.due(rows, F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("x07_policy", "SELECT s_suppkey AS source, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 100 WHEN s_suppkey % 3 = 0 THEN 10 WHEN s_suppkey % 3 = 1 THEN 20 END AS interval_ms FROM supplier")
def policy(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("source"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("c").alias("bucket"), F.when(k % 2 == 0, "event").otherwise("venue").alias("kind"))
    rules = spark.createDataFrame([("a", None, 10), ("b", None, 20), ("a", "event", 100)], "bucket string, kind string, interval_ms int")
    return state.policy(rows, rules).select("source", "interval_ms")


@query("x11_log_retention", f"SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), {DATE}) < 20")
def retention(spark, sf_dir):
    return state.keep_days(table(spark, sf_dir, "events"), "ts", _date(), 20).select("event_id")


@query("x12_source_status", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'waiting' WHEN n_nationkey % 5 = 1 THEN 'failed' WHEN n_nationkey % 5 = 2 THEN 'degraded' WHEN n_nationkey % 5 = 3 THEN 'changed' ELSE 'unchanged' END AS status FROM nation")
def source_status(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    return table(spark, sf_dir, "nation").select("n_nationkey", state.source_status(F.when(k != 0, 1), k == 1, k == 2, k == 3).alias("status"))


@query("x14_refresh", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS value, CASE WHEN n_nationkey % 3 = 1 THEN DATE '2024-02-01' END AS stale_since FROM nation")
def refresh(spark, sf_dir):
    k = F.col("n_nationkey")
    rules = table(spark, sf_dir, "nation").select(k.alias("id"), F.col("n_name").alias("value"), F.lit(None).cast("date").alias("stale_since"))
    fetched = table(spark, sf_dir, "nation").where(k % 3 < 2).select(k.alias("id"), F.lit("new").alias("value"), (k % 3 == 0).alias("ok"))
    return state.refreshed(rules, fetched, _date())


@query("x16_saved_items", """WITH i AS (SELECT c_custkey AS slug, c_custkey * 10 AS saved FROM customer WHERE c_custkey % 3 < 2), t AS (SELECT c_custkey AS slug, c_custkey * 20 AS saved FROM customer WHERE c_custkey % 3 > 0),
    k AS (SELECT * FROM i WHERE slug NOT IN (SELECT slug FROM t) UNION ALL SELECT * FROM t WHERE slug NOT IN (SELECT slug FROM i)) SELECT slug, CAST(p AS INTEGER) AS position FROM (SELECT *, row_number() OVER (ORDER BY saved DESC, slug) AS p FROM k) WHERE p <= 500""")
def saved_all(spark, sf_dir):
    """Items and toggles from all customers; the list's own limit of 500 stays."""
    c = table(spark, sf_dir, "customer")
    make = lambda rows, f: rows.select(F.lit("event").alias("kind"), F.col("c_custkey").alias("slug"), (F.col("c_custkey") * f).alias("saved_at"), F.lit(None).cast("long").alias("end_at"))
    return state.saved_items(make(c.where("c_custkey % 3 < 2"), 10), make(c.where("c_custkey % 3 > 0"), 20), F.lit(0)).select("slug", "position")


@query("q13_editor_picks", f"WITH {SESSIONS}, l AS (SELECT DISTINCT slug FROM s WHERE e >= {TODAY}) SELECT position, o_orderkey AS slug FROM (SELECT o_orderkey, o_orderkey % 10 AS position FROM orders) JOIN l ON slug = o_orderkey")
def editor_picks_all(spark, sf_dir):
    picks = table(spark, sf_dir, "orders").select(F.lit("1997-W24").alias("week"), (F.col("o_orderkey") % 10).alias("position"), F.col("o_orderkey").alias("slug"))
    live = sessions(spark, sf_dir).where(calendar.not_ended(TODAY))
    return discovery.editor_picks(picks, live, F.lit("1997-W24")).select("position", "slug")


@query("q16_here_past_near", f"WITH {SESSIONS} SELECT venue, slug, CASE WHEN e >= {TODAY} THEN 'here' ELSE 'past' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY venue, e >= {TODAY} ORDER BY CASE WHEN e >= {TODAY} THEN start_s ELSE -start_s END, slug) AS r FROM s) WHERE r <= 3")
def here_past(spark, sf_dir):
    live = calendar.end_of() >= TODAY
    order = F.when(live, F.col("start")).otherwise(-F.col("start"))
    ranked = sessions(spark, sf_dir).withColumn("part", F.when(live, "here").otherwise("past")).withColumn("r", F.row_number().over(W.partitionBy("venue", "part").orderBy(order, "slug")))
    return ranked.where("r <= 3").select("venue", "slug", "part")


@query("q32_fixed_order_list", "SELECT n_name, CAST(CASE n_regionkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS place FROM nation")
def fixed_order(spark, sf_dir):
    place = F.array_position(F.array(F.lit(2), F.lit(0)), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_name", F.when(place > 0, place - 1).otherwise(2).cast("int").alias("place"))


@query("q35_review_by_kind", "SELECT o_orderstatus AS kind, o_custkey % 50 AS item, count(*) AS impact FROM orders GROUP BY 1, 2 HAVING count(*) >= 2")
def review_by_kind(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 50).alias("item")).agg(F.count("*").alias("impact"))
    return counts.where("impact >= 2")


@query("q36_side_by_side", "SELECT l_orderkey AS entity, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS statuses, string_agg(DISTINCT l_returnflag, '/' ORDER BY l_returnflag) AS shown FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def side_by_side(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"), F.count_distinct("l_linestatus").alias("statuses"))
    return per.where(F.size("f") > 1).select("entity", F.size("f").cast("long").alias("flags"), "statuses", F.array_join("f", "/").alias("shown"))


@query("q38_year_groups", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def year_groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n")).where("n >= 10")


@query("q29_distance_order", "SELECT vec_id, CAST(round(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS BIGINT) AS d FROM embeddings ORDER BY abs(CAST(embedding[1] AS DOUBLE)), vec_id LIMIT 12")
def distance_order(spark, sf_dir):
    d = F.abs(F.col("embedding")[0].cast("double"))
    return table(spark, sf_dir, "embeddings").orderBy(d, "vec_id").limit(12).select("vec_id", F.round(d * 1000).cast("long").alias("d"))
