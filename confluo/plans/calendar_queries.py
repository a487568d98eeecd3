"""Calendar and interval queries; orders with their last shipping date stand for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import calendar, intervals
from .registry import query, table

DAY = 86_400
#: Fixed moments, in seconds: 1997-06-15 and 2024-01-15 (UTC).
TODAY, TODAY_EVENTS = 866_332_800, 1_705_276_800


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, title, cat, city, start, end: one per order; the shipping dates are reduced before the join."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l"))
    rows = orders.join(ends, orders["o_orderkey"] == ends["l_orderkey"], "left").join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])
    return rows.select(
        F.col("o_orderkey").alias("slug"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("cat"), F.col("n_name").alias("city"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start"), F.unix_seconds(F.col("l").cast("timestamp")).alias("end"), F.col("o_totalprice").alias("popularity"), (F.col("o_custkey") % 97).alias("venue"),
    )


SESSIONS = """
sessions AS (
  SELECT o_orderkey AS slug, 'order ' || o_orderkey AS title, o_orderpriority AS cat, n_name AS city, CAST(epoch(o_orderdate) AS BIGINT) AS start_s,
         CAST(epoch(l) AS BIGINT) AS end_s, o_totalprice AS popularity, o_custkey % 97 AS venue
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, coalesce(end_s, start_s) AS e FROM sessions)
"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions without ends; those within the first hour of a day count as all-day."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("slug"), F.col("event_type").alias("cat"), "user_id", "value", start.alias("start"), F.lit(None).cast("long").alias("end"), (start % DAY < 3600).alias("date_only"))


EVENTS = """
ev AS (SELECT event_id, event_type AS cat, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS start_s, CAST(floor(epoch(ts)) AS BIGINT) % 86400 < 3600 AS date_only FROM events)
"""


@query("q01_session_star", f"WITH {SESSIONS} SELECT slug, cat, city, start_s, e AS end_s FROM s")
def session_star(spark, sf_dir):
    return sessions(spark, sf_dir).select("slug", "cat", "city", F.col("start").alias("start_s"), calendar.end_of().alias("end_s"))


@query("q02_upcoming_orders", f"WITH {SESSIONS} SELECT slug, start_s < {TODAY} AS running, CASE WHEN start_s < {TODAY} THEN e ELSE start_s END AS sort FROM s WHERE e >= {TODAY}")
def upcoming_orders(spark, sf_dir):
    return calendar.upcoming(sessions(spark, sf_dir), TODAY).select("slug", "running", "sort")


@query("q03_past", f"WITH {SESSIONS} SELECT slug, e AS ended FROM s WHERE e < {TODAY}")
def past_orders(spark, sf_dir):
    return calendar.past(sessions(spark, sf_dir), TODAY).select("slug", calendar.end_of().alias("ended"))


@query(
    "q04_today_rank",
    f"WITH {EVENTS} SELECT event_id, CAST(CASE WHEN date_only THEN 1 WHEN start_s >= {TODAY_EVENTS + 43200} THEN 0 ELSE 2 END AS INTEGER) AS band FROM ev WHERE start_s >= {TODAY_EVENTS} AND start_s < {TODAY_EVENTS + DAY}",
)
def today_rank(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("band", calendar.today_band(TODAY_EVENTS + 43200, TODAY_EVENTS))
    return rows.where("band is not null").select("event_id", "band")


@query(
    "q05_running_today",
    f"""WITH {SESSIONS} SELECT slug, min(e) AS end_s FROM s WHERE start_s < {TODAY} AND e >= {TODAY}
    AND slug NOT IN (SELECT slug FROM s WHERE start_s >= {TODAY} AND start_s < {TODAY + DAY}) GROUP BY slug""",
)
def running(spark, sf_dir):
    return calendar.running_today(sessions(spark, sf_dir), TODAY).withColumnRenamed("end", "end_s")


@query("q06_tonight", f"WITH {EVENTS} SELECT event_id, start_s FROM ev WHERE NOT date_only AND start_s >= {TODAY_EVENTS + 19 * 3600} AND start_s < {TODAY_EVENTS + DAY}")
def tonight(spark, sf_dir):
    return calendar.tonight(event_rows(spark, sf_dir), TODAY_EVENTS).select("event_id", F.col("start").alias("start_s"))


@query(
    "q07_weekend_overlap",
    f"""WITH {SESSIONS}, r AS (SELECT * FROM s WHERE start_s < {TODAY + DAY} AND e >= {TODAY - DAY})
    SELECT slug, min(start_s) AS first_start, bool_or(start_s < {TODAY - DAY}) AS running,
    CAST(count(DISTINCT CASE WHEN start_s >= {TODAY - DAY} THEN (start_s - {TODAY - DAY}) // 86400 END) AS BIGINT) AS days FROM r GROUP BY slug""",
)
def weekend(spark, sf_dir):
    return calendar.in_range(sessions(spark, sf_dir), TODAY - DAY, TODAY + DAY).withColumn("days", F.col("days").cast("long"))


@query(
    "q08_weekend_by_city",
    f"WITH {SESSIONS} SELECT city, count(DISTINCT slug) AS n FROM s WHERE start_s < {TODAY + DAY} AND e >= {TODAY - DAY} GROUP BY city",
)
def weekend_by_city(spark, sf_dir):
    rows = sessions(spark, sf_dir).where((F.col("start") < TODAY + DAY) & (calendar.end_of() >= TODAY - DAY))
    return rows.groupBy("city").agg(F.count_distinct("slug").alias("n"))


@query("q09_year_table", f"WITH {SESSIONS} SELECT strftime(make_timestamp((start_s + 28800) * 1000000), '%Y-%m') AS month, e < {TODAY} AS past, count(*) AS n FROM s WHERE start_s < 883612800 AND e >= 852076800 AND e - start_s <= 366 * 86400 GROUP BY 1, 2")
def year_table(spark, sf_dir):
    lo, hi = 852_076_800, 883_612_800  # 1997
    rows = sessions(spark, sf_dir).where((F.col("start") < hi) & (calendar.end_of() >= lo) & (calendar.end_of() - F.col("start") <= 366 * DAY))
    return rows.groupBy(F.date_format(calendar.local_day(F.col("start")), "yyyy-MM").alias("month"), (calendar.end_of() < TODAY).alias("past")).agg(F.count("*").alias("n"))


@query("q10_soon_or_later", f"WITH {SESSIONS} SELECT slug, min(greatest(start_s, {TODAY})) AS at, min(greatest(start_s, {TODAY})) < {TODAY + 30 * DAY} AS soon FROM s WHERE e >= {TODAY} AND popularity < 50000 GROUP BY slug")
def soon_or_later(spark, sf_dir):
    rows = sessions(spark, sf_dir).where(calendar.not_ended(TODAY) & (F.col("popularity") < 50000))
    return rows.groupBy("slug").agg(F.min(F.greatest("start", F.lit(TODAY))).alias("at")).withColumn("soon", F.col("at") < TODAY + 30 * DAY)


@query(
    "q11_live_events",
    f"""WITH {EVENTS} SELECT user_id AS slug, min(start_s) AS start_s, max(start_s) AS end_s, min(CASE WHEN start_s >= {TODAY_EVENTS} THEN start_s END) AS next_s,
    count(DISTINCT cat) AS cities FROM ev GROUP BY 1 HAVING max(start_s) >= {TODAY_EVENTS}""",
)
def live_events(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("slug", F.col("user_id")).withColumn("city", F.col("cat")).withColumn("title", F.col("event_id"))
    return calendar.live_events(rows, TODAY_EVENTS).selectExpr("slug", "start as start_s", "end as end_s", "next as next_s", "cities")


@query(
    "q12_ending_soon",
    f"""WITH {SESSIONS} SELECT slug, e AS end_s FROM s WHERE start_s < {TODAY} AND e >= {TODAY} AND e - start_s >= 3 * 86400 AND e < {TODAY + 7 * DAY}
    ORDER BY e, popularity DESC, slug LIMIT 20""",
)
def ending_soon(spark, sf_dir):
    rows = calendar.ending_soon(sessions(spark, sf_dir), TODAY)
    return rows.orderBy(calendar.end_of(), F.desc("popularity"), "slug").limit(20).select("slug", calendar.end_of().alias("end_s"))


@query("q14_newly_listed", "WITH f AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS listed_at FROM orders GROUP BY 1) SELECT o_custkey, listed_at FROM f WHERE listed_at > (SELECT min(listed_at) FROM f) AND date_diff('day', listed_at, DATE '1995-06-01') < 30")
def newly_listed(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("listed_at"))
    return calendar.newly_listed(first, F.lit("1995-06-01").cast("date")).select("o_custkey", "listed_at")


@query("q20_city_months", f"""WITH {SESSIONS}, d AS (SELECT city, end_s, date_trunc('month', make_timestamp((start_s + 28800) * 1000000)) AS month, make_timestamp((e + 28800) * 1000000)::DATE AS last_day FROM s),
    p AS (SELECT city, month, 1 AS events, 0 AS ongoing FROM d WHERE CASE WHEN month < DATE '1997-06-01' THEN month >= DATE '1997-01-01' ELSE month <= DATE '1998-06-01' AND last_day >= DATE '1997-06-15' END
    UNION ALL SELECT city, page, 0, 1 FROM d, (VALUES (DATE '1997-06-01'), (DATE '1997-07-01')) m(page) WHERE end_s IS NOT NULL AND month < page AND last_day >= page AND last_day >= DATE '1997-06-15')
    SELECT city, CAST(month AS DATE) AS month, CAST(sum(events) AS BIGINT) AS events, CAST(sum(ongoing) AS BIGINT) AS ongoing, month < DATE '1997-06-01' AS past FROM p GROUP BY city, month
    HAVING month < DATE '1997-06-01' OR sum(events) + sum(ongoing) >= 5""")
def city_months(spark, sf_dir):
    return calendar.city_months(sessions(spark, sf_dir), TODAY, "1997-01-01")


@query("q22_category_city", f"WITH {SESSIONS} SELECT cat, city, count(DISTINCT slug) AS n FROM s GROUP BY 1, 2 HAVING count(DISTINCT slug) >= 20")
def category_city(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("cat", "city").agg(F.count_distinct("slug").alias("n")).where("n >= 20")


@query("q24_calendar_grid", f"WITH {EVENTS}, d AS (SELECT (start_s + 28800) // 86400 AS day, count(*) AS n FROM ev GROUP BY 1) SELECT day, n, max(n) OVER () AS most FROM d")
def calendar_grid(spark, sf_dir):
    days = event_rows(spark, sf_dir).groupBy(F.floor((F.col("start") + calendar.ZONE_SECONDS) / DAY).alias("day")).agg(F.count("*").alias("n"))
    return days.crossJoin(F.broadcast(days.agg(F.max("n").alias("most"))))  # a row for each day, and one row


@query("a13_showings", f"WITH {SESSIONS} SELECT city, venue, CAST(count(*) AS BIGINT) AS n, min(start_s) AS first_start FROM s GROUP BY 1, 2")
def showings(spark, sf_dir):
    rows = calendar.showings(sessions(spark, sf_dir).withColumn("title", F.col("city")))
    return rows.selectExpr("title as city", "venue", "cast(size(times) as long) as n", "times[0] as first_start")


@query("j17_interval_overlap_join", f"""WITH {SESSIONS}, w AS (SELECT * FROM s) SELECT a.slug AS a, b.slug AS b FROM w a JOIN w b
    ON a.venue = b.venue AND a.slug < b.slug AND a.start_s <= b.e AND b.start_s <= a.e""")
def interval_overlap(spark, sf_dir):
    """Pairs of intervals of one venue that overlap."""
    rows = sessions(spark, sf_dir).withColumn("end", calendar.end_of())
    return intervals.overlapping_pairs(rows.selectExpr("slug as id", "start", "end", "venue"), ["venue"])


#: Sales and lines as intervals: from the sale to its arrival, and the week before a line is shipped.
STAYS = """l AS (SELECT sale_id AS id, client_id % 50 AS place, CAST(floor(epoch(sold_at)) AS BIGINT) AS s, CAST(floor(epoch(arrived_at)) AS BIGINT) AS e FROM sales WHERE sold_at IS NOT NULL AND arrived_at IS NOT NULL),
    r AS (SELECT sale_id AS id, line_no, item_id % 50 AS place, CAST(floor(epoch(shipped_at)) AS BIGINT) - 3600 AS s, CAST(floor(epoch(shipped_at)) AS BIGINT) AS e FROM sale_lines WHERE shipped_at IS NOT NULL)"""


@query("j17_two_tables", f"WITH {STAYS} SELECT l.id AS sale_id, r.id AS line_sale, r.line_no FROM l JOIN r ON l.place = r.place AND l.s <= r.e AND r.s <= l.e")
def overlap_of_two_tables(spark, sf_dir):
    """Sales on their way while a line of the same shelf leaves."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    sales = table(spark, sf_dir, "sales").select(F.col("sale_id").alias("id"), seconds("sold_at").alias("start"), seconds("arrived_at").alias("end"), (F.col("client_id") % 50).alias("place"))
    lines = table(spark, sf_dir, "sale_lines").select(F.struct("sale_id", "line_no").alias("id"), (seconds("shipped_at") - 3600).alias("start"), seconds("shipped_at").alias("end"), (F.col("item_id") % 50).alias("place"))
    return intervals.overlap_join(sales, lines, ["place"]).select(F.col("l_id").alias("sale_id"), F.col("r_id.sale_id").alias("line_sale"), F.col("r_id.line_no"))


@query("f14_parse_dates", """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS iso, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS compact, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS roc,
    CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS han, strftime(o_orderdate, '%Y-%m-%d') || 'T09:05:00+08:00' AS naive FROM orders""")
def parse_dates(spark, sf_dir):
    """Order dates rendered in five notations and parsed back."""
    d = F.col("o_orderdate")
    shown = {
        "iso": F.date_format(d, "yyyy/M/d"), "compact": F.date_format(d, "yyyyMMdd"), "roc": F.concat((F.year(d) - 1911).cast("string"), F.date_format(d, ".MM.dd")),
        "han": F.date_format(d, "yyyy年M月d日"), "naive": F.date_format(d, "yyyy-MM-dd 9:05"),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", *(dates.parse_datetime(v)["value"].alias(k) for k, v in shown.items()))


@query("f26_iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def iso_week(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_week(F.col("o_orderdate").cast("date")).alias("week"))


@query("f27_weekend", """SELECT o_orderkey, CAST(CASE WHEN dayofweek(o_orderdate) = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + to_days(CAST(6 - dayofweek(o_orderdate) AS INTEGER)) END AS DATE) AS saturday FROM orders""")
def weekend_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.weekend_of(F.col("o_orderdate").cast("date"))["start"].alias("saturday"))
