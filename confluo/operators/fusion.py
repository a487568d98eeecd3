"""Field-level truth fusion: which of several sources' values counts, and what became of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nested


def freshness(age_days: Column) -> Column:
    """1.0 within 30 days or unknown, 0.85 within 180, 0.7 beyond."""
    return F.when(age_days.isNull() | (age_days <= 30), 1.0).when(age_days <= 180, 0.85).otherwise(0.7)


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates (entity, field, value, base, fresh, ordinal) with agree and score; a base of zero never counts.

    score = base x freshness x (1 + 0.2 for each further member with the same canonical value).
    """
    rows = candidates.where("base > 0 and value is not null").withColumn("canon", nested.canonical(candidates.schema["value"].dataType, F.col("value")))
    agree = F.count("*").over(W.partitionBy("entity", "field", "canon"))
    return rows.withColumn("agree", agree).withColumn("score", F.round(F.col("base") * F.col("fresh") * (1 + 0.2 * (F.col("agree") - 1)), 9))


def fused(candidates: DataFrame, cut: int = 120) -> DataFrame:
    """(entity, field, value, score, rejected): the best value, then the longer, then the first; other values cut short."""
    rows = scored(candidates).withColumn("rich", F.coalesce(F.col("value").try_cast("double"), F.length("value").cast("double")))
    order = F.struct("score", "rich", (-F.col("ordinal")).alias("o"))
    best = rows.groupBy("entity", "field").agg(F.max_by(F.struct("value", "canon", "score"), order).alias("w"), F.collect_set(F.struct("canon", F.substring("value", 1, cut).alias("value"))).alias("all"))
    lost = F.array_sort(F.array_distinct(F.transform(F.filter("all", lambda x: x["canon"] != F.col("w")["canon"]), lambda x: x["value"])))
    return best.select("entity", "field", F.col("w")["value"].alias("value"), F.col("w")["score"].alias("score"), lost.alias("rejected"))


def conflicts(candidates: DataFrame) -> DataFrame:
    """(entity, conflicts): fields with several canonical values from several sources (source)."""
    per = candidates.withColumn("canon", nested.canonical(candidates.schema["value"].dataType, F.col("value"))).groupBy("entity", "field").agg(F.count_distinct("canon").alias("v"), F.count_distinct("source").alias("s"))
    return per.groupBy("entity").agg(F.count(F.when((F.col("v") > 1) & (F.col("s") > 1), 1)).alias("conflicts"))


def union_sessions(rows: DataFrame) -> DataFrame:
    """(entity, sessions): sessions (entity, start, venue, ordinal) kept once for each start and venue, in order of start."""
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("entity", "start", "venue").orderBy("ordinal"))).where("_r = 1")
    return first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("start", "venue"))).alias("sessions"))


def without_superseded(members: DataFrame) -> DataFrame:
    """Drop members that vanished before their last day while a live member of their source is in the cluster.

    members: cluster, source, disappeared_at, last_day.
    """
    live = F.max(F.when(F.col("disappeared_at").isNull(), 1).otherwise(0)).over(W.partitionBy("cluster", "source"))
    marked = members.withColumn("_live", live)
    return marked.where("not (disappeared_at is not null and disappeared_at < last_day and _live = 1)").drop("_live")


def without_cancelled(members: DataFrame) -> DataFrame:
    """Per cluster and source: unless all sessions are cancelled, cancelled ones go (cluster, source, session_key, cancelled)."""
    every = F.min(F.col("cancelled").cast("int")).over(W.partitionBy("cluster", "source"))
    return members.withColumn("_all", every).where("_all = 1 or not cancelled").drop("_all")
