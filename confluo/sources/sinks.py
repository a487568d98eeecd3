"""Sinks: observation files, serving index, tables per day, search names, sitemap and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators.storage import written


def write_observations(rows: DataFrame, path: str) -> None:
    """Partitioned by source, sorted by id within each file; a large source is several files, one for each range of ids."""
    rows.repartitionByRange("source", "id").sortWithinPartitions("source", "id").write.mode("overwrite").partitionBy("source").json(path)


def serving_index(events: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with ordinals, sessions with the ordinal of their event): two tables that share a dense key.

    Ordinals follow the slug; they are counted within ranges of slugs, and offsets of the ranges are added.
    """
    ranged = events.repartitionByRange("slug").withColumn("_p", F.spark_partition_id())
    ranged = written(ranged, "index-events")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("_p")) - F.col("n")).select("_p", "before")  # one row for each range
    numbered = ranged.join(F.broadcast(before), "_p").withColumn("ordinal", F.col("before") + F.row_number().over(W.partitionBy("_p").orderBy("slug")) - 1).drop("_p", "before")
    return numbered, sessions.join(numbered.select("slug", "ordinal"), "slug").drop("slug")


def read_index(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with the fields of their events again."""
    return sessions.join(events, "ordinal").drop("ordinal")


def compact_json(fields: list[str]) -> Column:
    """One row as a JSON array."""
    values = [F.coalesce(F.nullif(F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null")) for f in fields]
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))


def write_days(sessions: DataFrame, path: str) -> None:
    """A folder for each day of a session's start; rows without a proper day are left out."""
    day = F.substring("start_at", 1, 10)
    sessions.withColumn("day", day).where(F.rlike("day", F.lit(r"^\d{4}-\d{2}-\d{2}$"))).write.mode("overwrite").partitionBy("day").json(path)


def venue_names(venues: DataFrame) -> DataFrame:
    """(name, slug, aliases) for the search box; the name itself is no alias."""
    return venues.select("name", "slug", F.array_except(text.aliases_of(F.col("name"), F.col("aliases")), F.array("name")).alias("aliases"))


def sitemap(pages: DataFrame, state: DataFrame, build_day: Column) -> DataFrame:
    """(path, lastmod) of the pages that are not kept out; a page without a state is in."""
    out = state.where("not indexable").select("path")
    return pages.join(out, "path", "left_anti").join(state.select("path", "changed_at"), "path", "left").select("path", F.coalesce("changed_at", build_day).alias("lastmod"))


def retired(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths of an earlier snapshot that are gone."""
    return before.select("path").distinct().join(now.select("path"), "path", "left_anti")


def delivery_checks(delivered: DataFrame, manifest: DataFrame, current: DataFrame) -> DataFrame:
    """For each delivered file (source, sha256, bytes, rows, fetched_at): the checks that it fails, empty if none.

    manifest: source, m_sha256, m_bytes, m_rows; current: source, c_rows, c_fetched_at.
    """
    both = delivered.join(manifest, "source", "left").join(current, "source", "left")
    failed = F.concat_ws(
        ",",
        F.when(F.col("m_sha256").isNull(), "unknown"),
        F.when(F.col("sha256") != F.col("m_sha256"), "checksum"),
        F.when(F.col("bytes") != F.col("m_bytes"), "size"),
        F.when(F.col("rows") != F.col("m_rows"), "count"),
        F.when(F.col("fetched_at") <= F.col("c_fetched_at"), "older"),
        F.when(F.col("rows") < F.col("c_rows") * 0.5, "shrunk"),
    )
    return both.select("source", failed.alias("failed"))
