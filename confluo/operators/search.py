"""Free-text search of many queries at once over a written index of substrings.

Search texts are folded: no white space, lower case, one spelling of Taiwan's first character. A query finds what contains
its folded text as a whole, or that text with an alias replaced by the formal name. Each wanted text is looked up under the
rarest of its substrings of the largest indexed size that fits it, then compared: short substrings stand in a fixed share of
all texts, so long wanted texts are not looked up under them. Rows with one text are one entry of the index, which keeps only those that can be shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .containment import contained_keys, grams

FIELDS = ("title", "venue", "city", "cat")
SHOWN, VENUES_SHOWN = 40, 6
#: Sizes of the substrings in the index; a text of n characters has at most n of each.
SIZES = (1, 2, 4, 8, 12)


def order_of(now: int) -> Column:
    """Running rows by their end, then coming ones by start, then past ones, the latest first."""
    end = F.coalesce("end", "start")
    band = F.when(end < now, 2).when(F.col("start") < now, 0).otherwise(1)
    return F.struct(band.alias("band"), F.when(band == 0, end).when(band == 1, F.col("start")).otherwise(-F.col("start")).alias("at"), "slug", "start")


class Index:
    """texts (id, hay, n, rows), grams (gram, id) and counts (gram, n) as tables in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.texts, self.grams, self.counts = (spark.read.parquet(f"{path.rstrip('/')}/{t}") for t in ("texts", "grams", "counts"))

    @classmethod
    def build(cls, rows: DataFrame, path: str, now: int, shown: int = SHOWN) -> Index:
        """Index rows (slug, title, venue, city, cat, start, end); of each text the first ``shown`` rows are kept, and their number.

        Null fields are empty. Rows without a start stand behind all past ones.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        hay = text.fold(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS)))
        rows = rows.select(hay.alias("hay"), order_of(now).alias("order"))
        first = rows.withColumn("r", F.row_number().over(W.partitionBy("hay").orderBy("order"))).where(F.col("r") <= shown)
        kept = first.groupBy("hay").agg(F.array_sort(F.collect_list("order")).alias("rows"))  # at most ``shown`` for each text
        counted = rows.groupBy("hay").agg(F.count("*").alias("n"))
        counted.join(kept, "hay").select(F.xxhash64("hay").alias("id"), "hay", "n", "rows").write.parquet(f"{path}/texts")
        texts = spark.read.parquet(f"{path}/texts")
        parts = F.concat(*(grams(F.col("hay"), n) for n in SIZES))  # distinct, as those of other sizes differ
        found = texts.select(F.explode(parts).alias("gram"), "id")
        found.sort("gram", "id").write.parquet(f"{path}/grams")  # sorted, so that a few grams read a few row groups
        spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
        return cls(spark, path)

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(needle, id): texts that hold the rarest of a needle's largest indexed substrings; all that hold the needle are among them."""
        needles = needles.where("needle <> ''").select("needle").distinct()
        own = F.coalesce(*(F.when(F.length("needle") >= n, grams(F.col("needle"), n)) for n in reversed(SIZES)))
        parts = needles.withColumn("gram", F.explode(own))
        known = parts.join(self.counts, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.when(F.col("n").isNull(), 1)).alias("lost"))
        return known.where("lost = 0").select("needle", "gram").join(self.grams, "gram").select("needle", "id").distinct()

    def holding(self, needles: DataFrame) -> DataFrame:
        """(needle, id, hay): texts that contain a needle. Empty needles find nothing."""
        return self.candidates(needles).join(self.texts.select("id", "hay"), "id").where(F.contains("hay", "needle")).select("needle", "id", "hay")


def alias_pairs(names: DataFrame) -> DataFrame:
    """(alias, formal), folded, of names (name, slug, position, aliases); empty aliases are none."""
    pairs = names.select(text.fold(F.col("name")).alias("formal"), F.explode("aliases").alias("a"))
    return pairs.select(text.fold(F.col("a")).alias("alias"), "formal").where("alias <> ''").distinct()


def wanted_texts(queries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(query, needle) of distinct queries (query): the folded query, and with each alias that it contains replaced, once."""
    folded = queries.where("query is not null").select("query").distinct().withColumn("needle", text.fold(F.col("query")))
    if names is None:
        return folded
    pairs = alias_pairs(names)
    inside = contained_keys(pairs.selectExpr("alias as key"), folded.selectExpr("needle as key"), least=1)
    replaced = F.concat(F.expr("substring(needle, 1, locate(alias, needle) - 1)"), F.col("formal"), F.expr("substring(needle, locate(alias, needle) + length(alias))"))
    more = folded.join(inside.selectExpr("needle as alias", "haystack as needle"), "needle").join(pairs, "alias").select("query", replaced.alias("needle"))
    return folded.unionByName(more).distinct()


def search(index: Index, queries: DataFrame, names: DataFrame | None = None, limit: int = SHOWN) -> DataFrame:
    """(query, found, rank, slug, start): the first rows of each query, and how many rows it finds.

    ``limit`` must not exceed what the index shows of each text. Null and blank queries, and those that find nothing, give no
    row; repeated queries give one result; repeated rows are found as often as they stand in the table.
    """
    hits = index.holding(wanted := wanted_texts(queries, names)).join(wanted, "needle").select("query", "id", "hay").distinct()
    entries = hits.join(index.texts, ["id", "hay"]).select("query", "n", F.slice("rows", 1, limit).alias("rows"))
    totals = entries.groupBy("query").agg(F.sum("n").alias("found"))
    rows = entries.select("query", F.explode("rows").alias("order"))
    best = rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("order"))).where(F.col("rank") <= limit)
    return best.join(totals, "query").select("query", "found", "rank", F.col("order.slug").alias("slug"), F.col("order.start").alias("start"))


def search_venues(queries: DataFrame, names: DataFrame, limit: int = VENUES_SHOWN) -> DataFrame:
    """(query, rank, name, slug): the first venues by position with a spelling that contains the query or, for queries of two
    characters and more, stands in it."""
    spellings = names.select("name", "slug", "position", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s"))
    keys = spellings.select("name", "slug", "position", text.fold(F.col("s")).alias("key")).where("key <> ''")
    folded = wanted_texts(queries).where("needle <> ''")
    longer = contained_keys(folded.selectExpr("needle as key"), keys, least=1).selectExpr("needle", "haystack as key")
    shorter = contained_keys(keys, folded.where("length(needle) >= 2").selectExpr("needle as key"), least=1).selectExpr("haystack as needle", "needle as key")
    hits = folded.join(longer.unionByName(shorter).distinct(), "needle").join(keys, "key").select("query", "position", "name", "slug").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("position", "slug")))
    return ranked.where(F.col("rank") <= limit).select("query", "rank", "name", "slug")
