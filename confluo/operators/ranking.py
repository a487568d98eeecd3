"""Top lists, caps, percentiles, rotation and sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written


def top_per_group(rows: DataFrame, groups: list[str], k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def tie_last_percentile(value: str, *groups: str) -> Column:
    """(rows up to and with this value - 1) / (rows - 1); null in groups of one."""
    w = W.partitionBy(*groups)
    upto = F.count("*").over(w.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow))
    n = F.count("*").over(w)
    return F.when(n > 1, (upto - 1) / (n - 1))


def capped(rows: DataFrame, group: str, order: str, first: str, second: str, cap: int, limit: int) -> DataFrame:
    """Greedy lists: in order, at most ``cap`` rows of each value of two keys and ``limit`` rows for each group.

    Which row is taken depends on those before, so each group is decided by itself, after leaving out rows that cannot be
    taken: of rows that agree in both keys only the first ``cap`` can.
    """
    some = rows.withColumn("_r", F.row_number().over(W.partitionBy(group, first, second).orderBy(order))).where(F.col("_r") <= cap).drop("_r")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[tuple[str, object], int] = {}
        keep = []
        for i, a, b in pdf.sort_values(order)[[first, second]].itertuples():
            if len(keep) < limit and seen.get(("a", a), 0) < cap and seen.get(("b", b), 0) < cap:
                seen["a", a], seen["b", b] = seen.get(("a", a), 0) + 1, seen.get(("b", b), 0) + 1
                keep.append(i)
        return pdf.loc[keep]

    return some.groupBy(group).applyInPandas(take, some.schema)


def interleave(*lists: DataFrame) -> DataFrame:
    """Lists with a column rank, merged one from each in turn; the column turn orders the result."""
    out = None
    for number, rows in enumerate(lists):
        rows = rows.withColumn("turn", F.col("rank") * len(lists) + number)
        out = rows if out is None else out.unionByName(rows)
    return out


def rotated(rows: DataFrame, order: str, seed: int, *groups: str) -> DataFrame:
    """Rows with place: their order turned by ``seed`` within their group."""
    w = W.partitionBy(*groups)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("place", F.pmod(r - seed, n))


def floor_quantiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row: min, the values at index floor(n share) of the sorted column, and max.

    A count per distinct value is aggregated first. Running sums over the distinct values find the places: within ranges of
    values, each sorted by its own task, behind the sum of the ranges before.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ranged = written(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()), "quantiles")
    sums = ranged.groupBy("_p").agg(F.sum("c").alias("s"))  # one row for each range
    before = sums.select("_p", (F.sum("s").over(W.orderBy("_p")) - F.col("s")).alias("_before"), F.sum("s").over(W.partitionBy()).alias("n"))
    upto = ranged.join(F.broadcast(before), "_p").withColumn("upto", F.col("_before") + F.sum("c").over(W.partitionBy("_p").orderBy(value)))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return upto.agg(F.min(value).alias("min"), *at, F.max(value).alias("max"))


def every_nth(rows: DataFrame, group: str, order: str, per: int) -> DataFrame:
    """A systematic sample: every floor(n / per)-th row of each group, at most ``per``."""
    w = W.partitionBy(group)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(n / per))
    return rows.withColumn("_r", r).withColumn("_s", step).where((F.col("_r") % F.col("_s") == 0) & (F.col("_r") / F.col("_s") < per)).drop("_r", "_s")


def last_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last rows in an order given as columns, still in that order."""
    reverse = [o.desc() for o in order]
    return rows.orderBy(*reverse).limit(n).orderBy(*[o.asc() for o in order])


#: A value is frequent if more than one of so many rows has it; there are fewer frequent values than that.
FREQUENT = 1000


def tie_last_places(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, c, upto, n): of each value of a group how many rows have it, have at most it, and are in the group.

    Rows are counted for each value first. The counts are cut into ranges of (group, value), summed within each, and put behind
    the sums of the ranges before, so a group with most of all rows is many tasks. Null groups and values are left out.
    """
    counts = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranged = written(counts.repartitionByRange(group, value).withColumn("_p", F.spark_partition_id()), "places")
    sums = ranged.groupBy(group, "_p").agg(F.sum("c").alias("s"))  # a row for each range that a group is in
    in_order = W.partitionBy(group).orderBy("_p")
    before = sums.select(group, "_p", (F.sum("s").over(in_order) - F.col("s")).alias("_before"), F.sum("s").over(W.partitionBy(group)).alias("n"))
    upto = F.col("_before") + F.sum("c").over(W.partitionBy("_p", group).orderBy(value))
    return ranged.join(before, [group, "_p"]).select(group, value, "c", upto.alias("upto"), "n")


def notability(rows: DataFrame, group: str = "source", value: str = "popularity", sources: str = "n_sources") -> DataFrame:
    """Rows with score: the sources beyond the first, plus the place of their popularity among those of their source, 0 to 1.

    Of equal values all take the last place. Without a popularity, or alone in their source, rows have place 0. Frequent values,
    fewer than FREQUENT, are joined by a broadcast, the others by a shuffle.
    """
    total = rows.count()
    places = written(tie_last_places(rows, group, value).withColumn("_place", F.when(F.col("n") > 1, (F.col("upto") - 1) / (F.col("n") - 1)).otherwise(0.0)), "notability")
    hot = F.broadcast(places.where(F.col("c") * FREQUENT > total).select(group, value, F.col("_place").alias("_hot")))
    rest = places.where(F.col("c") * FREQUENT <= total).select(group, value, "_place")
    first = rows.join(hot, [group, value], "left")
    settled = first.where(F.col("_hot").isNotNull() | F.col(group).isNull() | F.col(value).isNull()).withColumn("_place", F.coalesce("_hot", F.lit(0.0)))
    others = first.where(F.col("_hot").isNull() & F.col(group).isNotNull() & F.col(value).isNotNull()).join(rest, [group, value], "left")
    score = F.greatest(F.coalesce(F.col(sources), F.lit(1)) - 1, F.lit(0)) + F.coalesce("_place", F.lit(0.0))
    return settled.unionByName(others).withColumn("score", score).select(*rows.columns, "score")
