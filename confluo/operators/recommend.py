"""Recommendations: what is open in a span of time and fits a mood, near a person, and one of them picked.

Sessions stay flat rows: what an item offers in each span is an aggregate over them, so an item with many sessions is never
one long array. Lists keep the first rows that can be shown or picked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import nearest_in_rings
from .storage import written

HOUR, DAY = 3600, 86_400
ZONE_SECONDS = 8 * HOUR
#: Longer sessions, and those with a date only, are open all the time.
LONG_HOURS = 20
FIRST_NIGHT_HOUR = 19
#: How many of a list can be picked.
TOP = 40
ANY_MOOD = "now"

# Categories and words of the four moods, the moods of heritage, and what is never recommended.
MOOD_CATEGORIES = {
    "solo": ["展覽", "電影"],
    "friends": ["市集", "音樂", "演唱會", "獨立音樂", "節慶活動", "戲劇", "舞蹈", "綜藝"],
    "escape": ["遊憩活動", "節慶活動"],
    "different": ["研習課程", "講座"],
}
MOOD_WORDS = {
    "solo": ["書店", "散步", "放映", "走讀", "獨立書", "咖啡"],
    "friends": ["市集", "派對", "音樂節", "祭", "夜市", "嘉年華"],
    "escape": ["步道", "戶外", "森林", "海邊", "生態", "小旅行", "健行", "踏查", "單車"],
    "different": ["手作", "工作坊", "體驗", "DIY", "課程", "實作"],
}
HERITAGE_MOODS = ["escape", "solo"]
NEVER_CATEGORIES = ["競賽", "徵選"]
NEVER_WORDS = ["徵件", "募集", "徵選", "甄選", "徵稿", "招募", "徵求", "公開招標"]
NO_MOOD = "any"


def moods_of(category: Column, title: Column) -> Column:
    """array: moods by category or by a word of the title; 'any' alone if none fits, nothing for calls and contests."""
    category, title = F.coalesce(category, F.lit("")), F.coalesce(title, F.lit(""))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(title, w))
    fits = [F.when(category.isin(MOOD_CATEGORIES[m]) | has(MOOD_WORDS[m]), F.lit(m)) for m in MOOD_CATEGORIES]
    found = F.array_compact(F.array(*fits))
    none = F.array().cast("array<string>")
    return F.when(category.isin(NEVER_CATEGORIES) | has(NEVER_WORDS), none).when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_MOOD)))


@dataclass(frozen=True)
class Span:
    """[start, end) in epoch seconds; at night, long sessions and places are closed."""

    name: str
    start: int
    end: int
    night: bool = False


def spans(now: int) -> list[Span]:
    """The next three hours, tonight, half a day and the weekend of ``now``, in UTC+8."""
    midnight = now - (now + ZONE_SECONDS) % DAY
    weekday = (now + ZONE_SECONDS) // DAY % 7  # 1970-01-01, a Thursday, is 0
    saturday = midnight + ((2 - weekday) % 7 if weekday != 3 else -1) * DAY  # on a Sunday, the day before
    return [
        Span("soon", now, now + 3 * HOUR),
        Span("tonight", max(now, midnight + FIRST_NIGHT_HOUR * HOUR), midnight + DAY, night=True),
        Span("halfday", now, now + 6 * HOUR),
        Span("weekend", max(now, saturday), saturday + 2 * DAY),
    ]


def availability(items: DataFrame, sessions: DataFrame, when: list[Span]) -> DataFrame:
    """(slug, span, kind, at): what each item (slug, heritage) offers in each span, if anything.

    A session (slug, position, start, end, date_only) of a stated time is ``timed`` where it starts within the span, at its first
    start; one of a date only or of more than LONG_HOURS is ``open`` where it meets the span, until the end of the first by
    position, start and end (those without a position last), but not at night. Timed goes before open. Heritage is a ``place`` by day, whatever its sessions. A missing end is
    none; a session without a start counts for nothing.
    """
    end = F.when(F.col("end") != 0, F.col("end"))
    long = F.coalesce("date_only", F.lit(False)) | F.coalesce(end - F.col("start") > LONG_HOURS * HOUR, F.lit(False))
    until = F.coalesce(end, F.col("start") + DAY)
    first = F.struct(F.col("position").isNull(), "position", "start", until)
    found = []
    for s in when:
        timed = ~long & (F.col("start") >= s.start) & (F.col("start") < s.end)
        open_ = long & (F.col("start") < s.end) & (until > s.start) & F.lit(not s.night)
        found += [F.min(F.when(timed, F.col("start"))).alias(f"{s.name}_timed"), F.min_by(until, F.when(open_, first)).alias(f"{s.name}_open")]
    per = sessions.where("start is not null").groupBy("slug").agg(*found)
    rows = items.select("slug", F.coalesce("heritage", F.lit(False)).alias("heritage")).join(per.hint("merge"), "slug", "left")
    offers = []
    for s in when:
        place = F.when(F.lit(not s.night), F.struct(F.lit(s.name).alias("span"), F.lit("place").alias("kind"), F.lit(None).cast("long").alias("at")))
        one = lambda kind, s=s: F.struct(F.lit(s.name).alias("span"), F.lit(kind).alias("kind"), F.col(f"{s.name}_{kind}").cast("long").alias("at"))
        event = F.when(F.col(f"{s.name}_timed").isNotNull(), one("timed")).when(F.col(f"{s.name}_open").isNotNull(), one("open"))
        offers.append(F.when(F.col("heritage"), place).otherwise(event))
    return rows.select("slug", F.inline(F.array_compact(F.array(*offers))))


def matches(items: DataFrame, sessions: DataFrame, when: list[Span]) -> DataFrame:
    """(span, mood, slug, kind, at, score, heritage): every item (slug, heritage, moods, score) under each of its moods and ANY_MOOD.

    Items without a mood are never recommended.
    """
    items = written(items.select("slug", "moods", "score", "heritage"), "pool")  # moods are decided once
    fit = items.where(F.size("moods") > 0).withColumn("mood", F.explode(F.array_union("moods", F.array(F.lit(ANY_MOOD)))))
    fit = fit.select("slug", "mood", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("heritage", F.lit(False)).alias("heritage"))
    # exploded rows are more than Spark's estimate of them says, so neither side is broadcast
    return fit.join(availability(items, sessions, when).hint("merge"), "slug")


def recommended(matched: DataFrame, limit: int = TOP) -> DataFrame:
    """(span, mood, rank, slug, kind, at): the first rows of each list, one timed and one open in turn.

    Timed ones go by their start and score, open ones and places by score, places behind; ties by slug.
    """
    timed = F.col("kind") == "timed"
    order = F.struct(F.when(timed, F.col("at")).otherwise(0).alias("at"), (-F.col("score")).alias("score"), (~timed & F.col("heritage")).alias("place"), "slug")
    of_kind = W.partitionBy("span", "mood", "timed").orderBy("order")
    rows = matched.withColumn("timed", timed).withColumn("order", order).withColumn("r", F.row_number().over(of_kind)).where(F.col("r") <= limit)
    in_turn = W.partitionBy("span", "mood").orderBy("r", F.desc("timed"))  # at most two times ``limit`` rows
    return rows.withColumn("rank", F.row_number().over(in_turn)).where(F.col("rank") <= limit).select("span", "mood", "rank", "slug", "kind", "at")


def nearest(people: DataFrame, matched: DataFrame, places: DataFrame, limit: int = TOP) -> DataFrame:
    """(person, slug, rank, metres): for people (person, span, mood, lat, lng) the nearest items of their list.

    ``places`` (slug, lat, lng) are the items' points; items without one follow by slug, without metres, where fewer than
    ``limit`` have one. People without a point are left out.
    """
    known = places.where("lat is not null and lng is not null").groupBy("slug").agg(F.min(F.struct("lat", "lng")).alias("p")).select("slug", "p.*")
    rows = matched.select("span", "mood", "slug").distinct().join(known.hint("merge"), "slug", "left")
    located = people.where("lat is not null and lng is not null")
    near = nearest_in_rings(located.withColumnRenamed("person", "l_id"), rows.where("lat is not null").withColumnRenamed("slug", "r_id"), limit, ["span", "mood"])
    near = near.select(F.col("l_id").alias("person"), F.col("r_id").alias("slug"), "rank", "metres")
    found = located.select("person", "span", "mood").join(near.groupBy("person").agg(F.count("*").alias("n")).hint("merge"), "person", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = rows.where("lat is null").withColumn("r", F.row_number().over(W.partitionBy("span", "mood").orderBy("slug"))).where(F.col("r") <= limit)
    more = found.where(F.col("n") < limit).join(rest, ["span", "mood"]).withColumn("rank", (F.col("n") + F.col("r")).cast("int")).where(F.col("rank") <= limit)
    return near.unionByName(more.select("person", "slug", "rank", F.lit(None).cast("double").alias("metres")))


def picked(lists: DataFrame, people: DataFrame, seed: int, top: int = TOP, seen: Column | None = None) -> DataFrame:
    """(person, slug): one of the first ``top`` rows of each person's list (person, slug, rank) that is not in ``seen``.

    ``people`` has (person, seen: array of slugs). Where all are seen, one of them all. The draw is repeatable: the least digest
    of seed, person and slug wins, so a person gets another pick with another seed, and no other person's list matters.

    An array ``seen`` that follows from columns of ``people`` (person and these) may be given as an expression: it is then
    worked out once for each person behind the join, and not shuffled.
    """
    if seen is None:
        people, seen = people.select("person", "seen"), F.col("seen")
    lists = lists.where(F.col("rank") <= top).groupBy("person").agg(F.collect_list("slug").alias("_slugs"))  # ``top`` for each
    rows = lists.join(people.hint("merge"), "person").select("person", seen.alias("seen"), "_slugs")  # arrays made of a number look small, and are not broadcast
    rows = rows.select("person", "seen", F.explode("_slugs").alias("slug"))
    known = F.coalesce(F.array_contains("seen", F.col("slug")), F.lit(False))
    draw = F.md5(F.concat_ws("|", F.lit(seed), "person", "slug").cast("binary"))
    rows = rows.select("person", "slug", F.struct(known.alias("seen"), draw.alias("draw"), "slug").alias("_order"))
    return rows.groupBy("person").agg(F.min_by("slug", "_order").alias("slug"))
