"""Calendar queries over the session star: rows with slug, title, cat, city, start and end in epoch seconds.

A missing end is the start. Days begin at midnight in UTC+8. ``today`` is the first second of the day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
ZONE_SECONDS = 8 * 3600


def end_of(rows_end: str = "end", rows_start: str = "start") -> Column:
    return F.coalesce(rows_end, rows_start)


def not_ended(today: int) -> Column:
    return end_of() >= today


def upcoming(rows: DataFrame, today: int) -> DataFrame:
    """Not ended; place orders running ones by end, then coming ones by start."""
    running = F.col("start") < today
    rows = rows.where(not_ended(today)).withColumn("running", running)
    return rows.withColumn("sort", F.when(running, end_of()).otherwise(F.col("start")))


def past(rows: DataFrame, today: int) -> DataFrame:
    return rows.where(end_of() < today)


def today_band(now: int, today: int) -> Column:
    """0 for what still starts today, 1 for all-day rows, 2 for what has started; null for other days."""
    inside = (F.col("start") >= today) & (F.col("start") < today + DAY)
    return F.when(inside, F.when(F.col("date_only"), 1).when(F.col("start") >= now, 0).otherwise(2))


def running_today(rows: DataFrame, today: int) -> DataFrame:
    """One row per slug that spans today without starting today: its earliest end."""
    starting = rows.where((F.col("start") >= today) & (F.col("start") < today + DAY)).select("slug").distinct()
    spans = rows.where((F.col("start") < today) & (end_of() >= today))
    return spans.join(starting, "slug", "left_anti").groupBy("slug").agg(F.min(end_of()).alias("end"))


def tonight(rows: DataFrame, today: int, hour: int = 19) -> DataFrame:
    return rows.where(~F.col("date_only") & (F.col("start") >= today + hour * 3600) & (F.col("start") < today + DAY))


def in_range(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row per slug that meets [lo, hi): first start, whether it was running before, and the days it starts on."""
    meets = rows.where((F.col("start") < hi) & (end_of() >= lo))
    inside = F.when(F.col("start") >= lo, F.floor((F.col("start") - lo) / DAY))
    return meets.groupBy("slug").agg(F.min("start").alias("first_start"), F.max(F.col("start") < lo).alias("running"), F.size(F.collect_set(inside)).alias("days"))


def ending_soon(rows: DataFrame, today: int, least_days: int = 3, within_days: int = 7) -> DataFrame:
    """Running rows of at least some days that end within a week."""
    return rows.where((F.col("start") < today) & (end_of() >= today) & (end_of() - F.col("start") >= least_days * DAY) & (end_of() < today + within_days * DAY))


def live_events(rows: DataFrame, now: int) -> DataFrame:
    """One row per slug: start, end, next start, the cities, and a row to show."""
    nxt = F.min(F.when(F.col("start") >= now, F.col("start")))
    shown = F.min_by("title", F.struct(F.when(F.col("start") >= now, 0).otherwise(1), "start"))
    return rows.groupBy("slug").agg(F.min("start").alias("start"), F.max(end_of()).alias("end"), nxt.alias("next"), F.count_distinct("city").alias("cities"), shown.alias("title")).where(F.col("end") >= now)


def local_day(seconds: Column) -> Column:
    """The day in UTC+8, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + ZONE_SECONDS) / DAY).cast("int"))


def local_month(seconds: Column) -> Column:
    """The first day of the month in UTC+8."""
    return F.trunc(local_day(seconds), "month")


def city_months(rows: DataFrame, today: int, first_month: str, least: int = 5) -> DataFrame:
    """(city, month, events, ongoing, past): the pages of a city's months, by the month in which a row starts.

    From the month of ``today`` to a year ahead count rows that have not ended. In this month and the next, rows that
    started before it and still run in it count as ongoing; both together must reach ``least``. Earlier months stay from
    ``first_month`` on, with any row. Rows without a city count nowhere.
    """
    now, this = F.lit(today).cast("long"), local_month(F.lit(today).cast("long"))
    rows = rows.where("city is not null").withColumns({"month": local_month(F.col("start")), "last_day": local_day(end_of())})
    past = F.col("month") < this
    alive = F.col("last_day") >= local_day(now)
    shown = rows.where(F.when(past, F.col("month") >= F.lit(first_month).cast("date")).otherwise((F.col("month") <= F.add_months(this, 12)) & alive))
    starts = shown.select("city", "month", F.lit(1).alias("events"), F.lit(0).alias("ongoing"), past.alias("past"))
    soon = rows.where(F.col("end").isNotNull() & alive).withColumn("page", F.explode(F.array(this, F.add_months(this, 1))))
    runs = soon.where("month < page and last_day >= page").selectExpr("city", "page as month", "0 as events", "1 as ongoing", "false as past")
    counted = starts.union(runs).groupBy("city", "month").agg(F.sum("events").alias("events"), F.sum("ongoing").alias("ongoing"), F.bool_or("past").alias("past"))
    return counted.where(F.col("past") | (F.col("events") + F.col("ongoing") >= least))


def showings(rows: DataFrame) -> DataFrame:
    """(title, venue, times): repeated showings as one."""
    return rows.groupBy("title", "venue").agg(F.array_sort(F.collect_list("start")).alias("times"))


def series_pairs(rows: DataFrame) -> DataFrame:
    """(slug, other): editions of one series (series_key, year, slug) in other years."""
    a, b = rows.selectExpr("series_key", "year as y1", "slug"), rows.selectExpr("series_key", "year as y2", "slug as other")
    return a.join(b, "series_key").where("y1 <> y2 and slug <> other").select("slug", "other").distinct()


def series_key(title: Column) -> Column:
    """A title without its year or edition, null without a year or when too little is left."""
    year = r"(?:19|20)\d{2}|第?[0-9一二三四五六七八九十]+屆"
    left = F.regexp_replace(F.regexp_replace(title, year, ""), r"[\s\p{P}\p{S}]", "")
    return F.when(F.rlike(title, F.lit(r"(?:19|20)\d{2}")) & (F.length(left) >= 4), F.lower(left))


def newly_listed(rows: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Rows (listed_at) of the last days, without those of the first day of all."""
    launch = F.broadcast(rows.agg(F.min("listed_at").alias("_l")))  # one row
    return rows.join(launch, F.col("listed_at") > F.col("_l")).where(F.datediff(today, F.col("listed_at")) < days).drop("_l")
