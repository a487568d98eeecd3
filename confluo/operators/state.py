"""State carried between runs: page scores and hysteresis, schedules, health and saved items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAVE, ENTER, HOLD_DAYS = 3.0, 5.0, 2
GRACE_DAYS, LONG_GRACE_DAYS, LONG_GRACE_IMPRESSIONS = 60, 180, 10


def _sum(*rules: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for condition, points in rules:
        total = total + F.when(condition, F.lit(float(points))).otherwise(0.0)
    return total


def ended_beyond_grace(end: Column, today: Column, impressions: Column) -> Column:
    age = F.datediff(today, end)
    return (age > GRACE_DAYS) & ~((age <= LONG_GRACE_DAYS) & (F.coalesce(impressions, F.lit(0)) >= LONG_GRACE_IMPRESSIONS))


def event_score(c, today: Column) -> Column:
    """Points of an event page; ``c`` maps names to columns."""
    return _sum(
        (F.length(c["title"]) >= 6, 1), (c["venue"].isNotNull(), 1), (c["description"].isNotNull(), 2), (c["city"].isNotNull(), 1), (c["district"].isNotNull(), 0.5),
        (c["lat"].isNotNull(), 1), (c["precision"] == "street", 1), (c["category"].isNotNull(), 0.5), (c["sessions"] > 1, 0.5), (c["sources"] > 1, 1), (c["images"] > 0, 0.5),
        (ended_beyond_grace(c["end"], today, c["impressions"]), -4), (c["thin"], -1),
    )


def venue_score(c) -> Column:
    return _sum(
        (c["events"] >= 1, 2), (c["events"] >= 5, 2), (c["events"] >= 20, 1), (c["lat"].isNotNull(), 1), (c["precision"] == "street", 1.5),
        (c["city"].isNotNull() & ~F.coalesce(c["precision"] == "street", F.lit(False)), 0.5), (c["description"].isNotNull(), 1), (c["registry"], 0.5), (c["hours"].isNotNull(), 1),
    )


def heritage_score(c) -> Column:
    return _sum((c["history"].isNotNull(), 3), (F.length(c["history"]) >= 1000, 1), (c["lat"].isNotNull(), 1), (c["precision"] == "street", 1), (c["level"].isNotNull(), 1), (c["images"] > 0, 0.5))


def hysteresis(scores: DataFrame, previous: DataFrame, today: Column, gate: Column | None = None) -> DataFrame:
    """(path, score, indexable, qualified_since, gated) from the scores (path, score) and the state of the last run.

    A page that was in, or was gated, stays from LEAVE points on. Outside, ENTER points are needed, on the first run or
    for a new page at once, else for HOLD_DAYS days in a row. A gate keeps a page out whatever its score.
    """
    first_run = previous.limit(1).count() == 0
    p = previous.selectExpr("path", "indexable as was", "qualified_since as since", "gated as was_gated", "true as known")
    gated = F.coalesce(gate, F.lit(False)) if gate is not None else F.lit(False)
    rows = scores.withColumn("gated", gated).join(p, "path", "left")
    inside = F.coalesce("was", F.lit(False)) | F.coalesce("was_gated", F.lit(False))
    since = F.when(F.col("score") >= ENTER, F.coalesce("since", today))
    new = F.lit(first_run) | F.col("known").isNull()
    enters = (F.col("score") >= ENTER) & (new | (F.datediff(today, since) >= HOLD_DAYS))
    good = F.when(inside, F.col("score") >= LEAVE).otherwise(enters)
    return rows.select("path", "score", (good & ~F.col("gated")).alias("indexable"), since.alias("qualified_since"), (good & F.col("gated")).alias("gated"))


def next_interval(outcome: Column, interval: Column, misses: Column, low: Column, high: Column) -> Column:
    """Milliseconds until the next fetch: half after a change, half more after none, a month after ten misses."""
    month = 30 * 86_400_000
    longer = F.when(misses >= 10, F.lit(month)).otherwise(F.least(interval * 1.5, high))
    return F.when(outcome == "changed", F.greatest(interval / 2, low)).when(outcome == "unchanged", longer).otherwise(interval).cast("long")


def due(rows: DataFrame, now: Column, everything: bool = False) -> DataFrame:
    """Sources (forced, skip, next_due) to fetch now."""
    return rows.where(F.coalesce("forced", F.lit(False)) | (~F.coalesce("skip", F.lit(False)) & (F.lit(everything) | F.col("next_due").isNull() | (F.col("next_due") <= now))))


# Words of declared update frequencies; a number may stand between the parts of those in PERIODS.
NOT_CHECKED, IRREGULAR = "unverified", "不定期"
WORDS = {"daily": ["dail", "daily"], "monthly": [], "yearly": ["yearl", "yearly", "annually"]}
PHRASES = {"daily": ["每日", "每1日", "每天", "unittime=日"], "monthly": ["每季", "半年"], "yearly": []}
PERIODS = {"monthly": "每月", "yearly": "每年"}
HOUR = 3_600_000
# First, least and longest time between fetches, in hours, by frequency and kind.
POLICIES = {
    ("daily", "event"): (3, 1, 12), ("irregular", "event"): (6, 3, 24), ("undeclared", "event"): (6, 3, 24), ("monthly", "event"): (72, 24, 168), ("yearly", "event"): (168, 72, 336),
    ("daily", "directory"): (24, 12, 72), ("irregular", "directory"): (24, 12, 72), ("undeclared", "directory"): (24, 12, 72), ("monthly", "directory"): (168, 72, 336), ("yearly", "directory"): (336, 168, 720),
}


def freq_bucket(text: Column) -> Column:
    """A declared update frequency as undeclared, irregular, daily, monthly or yearly; what says none of these is undeclared.

    It says a bucket by one of its words or phrases, or by its period; a number of years says yearly.
    """
    said = F.lower(F.coalesce(text, F.lit("")))
    tight = F.regexp_replace(said, r"\s", "")
    words, periods = F.split(said, "[^a-z0-9_]+"), F.regexp_replace(tight, "[0-9]", "")

    def says(bucket: str) -> Column:
        found = F.arrays_overlap(words, F.array(*map(F.lit, WORDS[bucket]))) if WORDS[bucket] else F.lit(False)
        for phrase in PHRASES[bucket]:
            found = found | F.contains(tight, F.lit(phrase))
        if bucket in PERIODS:
            found = found | F.contains(periods, F.lit(PERIODS[bucket]))
        return found | F.rlike(tight, F.lit("[0-9]年")) if bucket == "yearly" else found

    bucket = F.when((tight == "") | F.startswith(said, F.lit(NOT_CHECKED)), "undeclared").when(F.contains(said, F.lit(IRREGULAR)), "irregular")
    for name in ("daily", "monthly", "yearly"):
        bucket = bucket.when(says(name), name)
    return bucket.otherwise("undeclared")


def scheduled(bucket: Column, entity: Column) -> Column:
    """struct<interval_ms, min_ms, max_ms>: the policy of a frequency for events, or for anything else."""
    kind = F.when(entity == "event", "event").otherwise("directory")
    times = lambda hours: F.struct(*(F.lit(h * HOUR).alias(n) for n, h in zip(("interval_ms", "min_ms", "max_ms"), hours)))
    return F.coalesce(*(F.when((bucket == b) & (kind == k), times(hours)) for (b, k), hours in POLICIES.items()))


def shrunk(count: Column, previous: Column) -> Column:
    """Whether a delivery has less than half of the rows of the last one."""
    return F.coalesce((previous > 0) & (count < previous * 0.5), F.lit(False))


#: Shares of the former peak, or of a rolling window, below which a source fails or is warned of; days without a change.
SHRINK_FAIL, SHRINK_WARN, STALE_DAYS = 0.5, 0.8, 90


def health(counts: DataFrame) -> DataFrame:
    """Problems and verdict (ok, warn or fail, the worst of them) of each source.

    counts: source, live, gone, first_days and changed_days (days since the first observation and the last change), rolling
    (rows that a rolling list holds, null for others) and fetched (rows of its last fetch). Rows that went after their end
    count as neither live nor gone. A rolling list is judged by its last fetch alone, and is never stale; another source is
    stale after STALE_DAYS without a change, if it has been observed for as long. problems has one entry for each problem,
    as level:name.
    """
    total = F.col("live") + F.col("gone")
    ratio = F.when(F.col("rolling").isNull(), F.col("live") / F.nullif(total, F.lit(0))).otherwise(F.col("fetched") / F.col("rolling"))
    shrunken = F.when(ratio < SHRINK_FAIL, "fail:shrunk").when(ratio < SHRINK_WARN, "warn:shrunk")
    stale = F.when(F.col("rolling").isNull() & (F.col("first_days") >= STALE_DAYS) & (F.col("changed_days") >= STALE_DAYS), "warn:stale")
    unknown = F.when(F.col("rolling").isNotNull() & F.col("fetched").isNull(), "warn:unknown")
    problems = F.when(total == 0, F.array(F.lit("fail:empty"))).otherwise(F.array_compact(F.array(shrunken, unknown, stale)))
    worst = F.array_min(F.transform(problems, lambda p: F.substring_index(p, ":", 1)))  # fail sorts before warn
    return counts.withColumn("ratio", F.round(ratio, 6)).withColumn("problems", problems).withColumn("verdict", F.coalesce(worst, F.lit("ok")))


def source_status(fetched: Column, failed: Column, rejected: Column, changed: Column) -> Column:
    return F.when(fetched.isNull(), "waiting").when(failed, "failed").when(rejected, "degraded").when(changed, "changed").otherwise("unchanged")


def keep_days(log: DataFrame, at: str, today: Column, days: int = 30) -> DataFrame:
    return log.where(F.datediff(today, F.col(at)) < days)


def saved_items(items: DataFrame, toggles: DataFrame, now: Column, most: int = 500) -> DataFrame:
    """Saved items (kind, slug, saved_at, end_at) after toggles: one of an item removes, of another adds; newest first."""
    add = toggles.join(items, ["kind", "slug"], "left_anti").select(*items.columns)
    kept = items.join(toggles, ["kind", "slug"], "left_anti").unionByName(add).where(F.col("end_at").isNull() | (F.col("end_at") >= now))
    order = [F.desc("saved_at"), F.asc("kind"), F.asc("slug")]
    first = kept.orderBy(*order).limit(most)  # each task keeps so many at most before they meet
    return first.withColumn("position", F.row_number().over(W.orderBy(*order)))


def recency_gate(pages: DataFrame, upcoming: DataFrame, near: DataFrame) -> DataFrame:
    """(path, gated): venues without upcoming events, and heritage with nothing here or near and without visit information.

    pages: path, kind, visit (boolean); upcoming and near: path.
    """
    up = upcoming.select("path").distinct().withColumn("up", F.lit(True))
    by = near.select("path").distinct().withColumn("by", F.lit(True))
    rows = pages.join(up, "path", "left").join(by, "path", "left")
    here, around = F.coalesce("up", F.lit(False)), F.coalesce("by", F.lit(False))
    gated = F.when(F.col("kind") == "venue", ~here).when(F.col("kind") == "heritage", ~here & ~around & ~F.coalesce("visit", F.lit(False))).otherwise(False)
    return rows.select("path", gated.alias("gated"))


def policy(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (source, bucket, kind) with the policy (bucket, kind, interval_ms); a null kind of the table holds for all kinds."""
    exact = table.where("kind is not null").withColumnRenamed("interval_ms", "i1")
    general = table.where("kind is null").select("bucket", F.col("interval_ms").alias("i2"))
    return rows.join(exact, ["bucket", "kind"], "left").join(general, "bucket", "left").select("source", "bucket", "kind", F.coalesce("i1", "i2").alias("interval_ms"))


def refreshed(rules: DataFrame, fetched: DataFrame, today: Column) -> DataFrame:
    """Curated rules (id, value, stale_since) after a refresh (id, value, ok): failures keep the old value and their first day."""
    f = fetched.selectExpr("id", "value as new", "ok")
    good = F.coalesce("ok", F.lit(True))
    return rules.join(f, "id", "left").select("id", F.when(F.col("ok"), F.col("new")).otherwise(F.col("value")).alias("value"), F.when(F.coalesce("ok", F.lit(False)), None).when(~good, F.coalesce("stale_since", today)).otherwise(F.col("stale_since")).alias("stale_since"))
