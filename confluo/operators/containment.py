"""Names inside names, and the venues that are heritage sites.

Strings that contain others are found by an equi-join on substrings: each needle is looked up under that one of its
substrings which the fewest haystacks have, so frequent words cost nothing where a needle has a rarer part. Substrings have
four characters, or as many as a shorter needle has. Rows with the
same key meet once, as one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .spatial import degrees_for
from .storage import written

GRAM = 4


def grams(key: Column, size: int) -> Column:
    """Distinct substrings of a size; none of shorter strings."""
    found = F.transform(F.sequence(F.lit(1), F.length(key) - (size - 1)), lambda i: F.substring(key, i, F.lit(size)))
    return F.when(F.length(key) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def contained_keys(needles: DataFrame, haystacks: DataFrame, least: int = GRAM) -> DataFrame:
    """Distinct (needle, haystack): keys of at least ``least`` characters that stand inside other keys, or equal them.

    ``needles`` and ``haystacks`` have a column ``key``; nulls and empty keys meet nothing, repeated keys count once.
    """
    short = needles.where(F.length("key") >= max(1, least)).select(F.col("key").alias("needle")).distinct()
    size = F.least(F.length("needle"), F.lit(GRAM))
    sizes = sorted(r.n for r in short.select(size.alias("n")).distinct().collect())  # numbers from 1 to GRAM
    none = F.array().cast("array<string>")
    parts = F.concat(none, *(grams(F.col("haystack"), n) for n in sizes))
    hay = haystacks.where("key <> ''").select(F.col("key").alias("haystack")).distinct().withColumn("gram", F.explode(parts))
    counted = hay.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.coalesce(*(F.when(size == n, grams(F.col("needle"), n)) for n in sizes), none)
    looked_up = short.withColumn("gram", F.explode(own)).hint("merge").join(counted, "gram", "left")
    rarest = looked_up.groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.when(F.col("n").isNull(), 1)).alias("lost"))
    return rarest.where("lost = 0").select("needle", "gram").hint("merge").join(hay, "gram").where(F.contains("haystack", "needle")).select("needle", "haystack")


# Kinds of heritage that are places, and what a venue's name may say of its status.
TANGIBLE = ("古蹟", "歷史建築", "聚落建築群", "紀念建築", "考古遺址", "文化景觀", "史蹟")
RANKS = ("國定", "直轄市定", "市定", "縣市定", "縣定")
MONUMENT = "古蹟"
BUILDINGS = ("歷史建築", "紀念建築")

EXACT_M, CONTAINS_M = 1000, 300
LEAST_KEY, LEAST_INNER, LEAST_WITHOUT_PLACE = 3, 4, 5


def strip_status(key: Column) -> Column:
    """A venue's key without the status in front."""
    heads = [*(rank + MONUMENT for rank in RANKS), MONUMENT, *BUILDINGS]
    found = F.coalesce(*(F.when(F.startswith(key, F.lit(h)), F.substr(key, F.lit(len(h) + 1))) for h in heads))
    return F.coalesce(found, key)


def heritage_keys(names: DataFrame) -> DataFrame:
    """Distinct (id, key) of (id, name): the whole name, the name without brackets, and what brackets hold.

    Keys have three characters at least, those of brackets four, so that a grade in brackets is no name.
    """
    outside = F.regexp_replace("name", "[（(][^）)]*[）)]", "")
    inside = F.regexp_extract_all("name", F.lit("[（(]([^）)]+)[）)]"), 1)
    part = lambda value, least: F.struct(value.alias("part"), F.lit(least).alias("least"))
    parts = F.concat(F.array(part(F.col("name"), LEAST_KEY), part(outside, LEAST_KEY)), F.transform(inside, lambda x: part(x, LEAST_INNER)))
    rows = names.where("name is not null").select("id", F.explode(parts).alias("p"))
    rows = rows.select("id", text.norm_venue(F.col("p.part")).alias("key"), F.col("p.least").alias("least"))
    return rows.where(F.length("key") >= F.col("least")).select("id", "key").distinct()


PLACE = ["city", "district", "lat", "lng"]


def _profiles(rows: DataFrame, keys: list[str], named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in keys and place as one profile (id of the first, whether there are more), and (profile, id).

    Rows that decisions name stay alone, so that a decision holds for them only.
    """
    alone = rows.hint("merge").join(named.select("id").distinct().withColumn("alone", F.col("id")), "id", "left")
    profile = F.struct(*keys, *PLACE, "alone")
    alone = written(alone, "places")
    heads = alone.groupBy(profile.alias("p")).agg(F.min("id").alias("profile"), (F.count_distinct("id") > 1).alias("many"))
    return heads.select("profile", "many", "p.*"), alone.select(profile.alias("p"), "id").hint("merge").join(heads.select("p", "profile"), "p").select("profile", "id")


def heritage_sites(heritages: DataFrame, venues: DataFrame, reject: DataFrame | None = None, link: DataFrame | None = None) -> DataFrame:
    """(heritage_id, venue_id, method, confidence, metres): the heritage site that a venue is or belongs to.

    Both sides have (id, name, city, district, lat, lng). An equal name holds within 1 km, where both have a place; a heritage
    key inside a venue's key within 300 m, or in one district if a place is missing and the key has five characters. Cities
    must agree or be unknown. Equal names go before contained ones, then longer keys; a venue for which two sites are as
    good gets none. ``link`` (heritage_id, venue_id) decides before, ``reject`` rules pairs out.

    Venues without a name get nothing; of repeated rows of a venue's id the surest stands; empty tables give an empty result. Rows
    of one name and place meet as one, and located rows meet in cells, so a name that a third of the rows has is not paired
    row by row.
    """
    spark = venues.sparkSession
    pairs = "heritage_id string, venue_id string"
    cast = lambda df: df.select(F.col("heritage_id").cast("string"), F.col("venue_id").cast("string")).distinct()
    reject = cast(reject) if reject is not None else spark.createDataFrame([], pairs)
    link = cast(link) if link is not None else spark.createDataFrame([], pairs)
    heritages, venues = (df.select(F.col("id").cast("string").alias("id"), "name", *PLACE).dropDuplicates() for df in (heritages, venues))
    link = link.hint("merge").join(heritages.selectExpr("id as heritage_id"), "heritage_id", "left_semi").hint("merge").join(venues.selectExpr("id as venue_id"), "venue_id", "left_semi")
    venues = venues.hint("merge").join(link.select(F.col("venue_id").alias("id")), "id", "left_anti")

    keyed = heritages.hint("merge").join(heritage_keys(heritages), "id").select("id", "key", *PLACE)
    h_rows, _ = _profiles(keyed, ["key"], reject.selectExpr("heritage_id as id"))
    v_rows, v_ids = _profiles(venues.withColumn("vkey", text.norm_venue(F.col("name"))).where("vkey <> ''").select("id", "vkey", *PLACE), ["vkey"], reject.selectExpr("venue_id as id"))
    h_rows, v_rows = written(h_rows, "sites"), v_rows.withColumn("bare", strip_status(F.col("vkey")))

    inner = contained_keys(h_rows.select("key"), v_rows.selectExpr("vkey as key"), LEAST_INNER).selectExpr("needle as key", "haystack as vkey")
    exact = v_rows.select("*", F.explode(F.array_distinct(F.array("vkey", "bare"))).alias("key"), F.lit(2).alias("rank"))
    inside = v_rows.hint("merge").join(inner, "vkey").where("key <> vkey and key <> bare").select(*v_rows.columns, "key", F.lit(1).alias("rank"))
    wanted = written(exact.unionByName(inside).select("profile", "key", "rank", "alone", *[F.col(c).alias(f"v_{c}") for c in PLACE]), "named-venues")
    sites = h_rows.select(F.col("profile").alias("site"), "many", "key", F.col("alone").alias("h_alone"), *[F.col(c).alias(f"h_{c}") for c in PLACE])

    v_located, h_located = F.expr("v_lat is not null and v_lng is not null"), F.expr("h_lat is not null and h_lng is not null")
    d = degrees_for(EXACT_M + 1)
    near = wanted.where(v_located).withColumn("cell", F.explode(geo.cells_around(F.col("v_lat"), F.col("v_lng"), d))).hint("merge").join(
        sites.where(h_located).withColumn("cell", geo.cell(F.col("h_lat"), F.col("h_lng"), d)), ["key", "cell"])
    near = near.withColumn("metres", F.round(geo.haversine_m(F.col("h_lat"), F.col("h_lng"), F.col("v_lat"), F.col("v_lng"))).cast("long"))
    near = near.where(F.col("metres") <= F.when(F.col("rank") == 2, EXACT_M).otherwise(CONTAINS_M)).drop("cell")
    # without a place on one side, names decide if they are equal, and districts else
    unplaced = [(wanted.where(~v_located), sites), (wanted.where(v_located), sites.where(~h_located))]
    found = near
    for v, h in unplaced:
        by_name = v.where("rank = 2").hint("merge").join(h, "key")
        by_district = v.where(f"rank = 1 and length(key) >= {LEAST_WITHOUT_PLACE}").hint("merge").join(h.withColumn("v_district", F.col("h_district")), ["key", "v_district"])
        found = found.unionByName(by_name.withColumn("metres", F.lit(None).cast("long"))).unionByName(by_district.withColumn("metres", F.lit(None).cast("long")))
    found = found.where("v_city is null or h_city is null or v_city = h_city")
    banned = reject.selectExpr("heritage_id as h_alone", "venue_id as alone")
    found = found.hint("merge").join(banned, ["h_alone", "alone"], "left_anti")

    order = F.struct("rank", F.length("key").alias("size"))
    levels = found.groupBy("profile", order.alias("o")).agg(F.min("site").alias("site"), F.max("site").alias("other"), F.max("many").alias("many"), F.min("metres").alias("metres"))
    best = levels.groupBy("profile").agg(F.max_by(F.struct("site", "other", "many", "metres", "o"), "o").alias("b")).where("b.site = b.other and not b.many")
    exactly = F.col("b.o.rank") == 2
    chosen = best.hint("merge").join(v_ids, "profile").select(
        F.col("b.site").alias("heritage_id"), F.col("id").alias("venue_id"), F.when(exactly, "exact-name").otherwise("name-contains").alias("method"),
        F.when(exactly, 0.9).otherwise(0.7).alias("confidence"), F.col("b.metres").alias("metres"))
    manual = link.select("heritage_id", "venue_id", F.lit("manual").alias("method"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("metres"))
    single = chosen.groupBy("venue_id").agg(F.max_by(F.struct(*chosen.columns), F.struct("confidence", "heritage_id", "metres")).alias("c")).select("c.*")
    return manual.unionByName(single)
