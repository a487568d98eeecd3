"""Free-text search over the shop's clients, with queries and aliases made of the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, storage
from .registry import query, table

NOW = 1_710_000_000

#: Cities as venue names with an alias; queries are cities in capitals, parts of them, aliases among other words, and names.
NAMES = "SELECT DISTINCT city AS name, lower(city) AS slug, CASE WHEN length(city) >= 5 THEN substr(city, 2, 3) || 'x' END AS alias FROM clients WHERE city IS NOT NULL"
QUERIES = """SELECT DISTINCT ' ' || upper(city) AS query FROM client_changes WHERE city IS NOT NULL UNION SELECT substr(city, 1, 2) || ' ' || substr(city, 3, 1) FROM client_changes WHERE city IS NOT NULL
    UNION SELECT upper(substr(city, 2, 3)) || 'x' FROM client_changes WHERE length(city) >= 5 UNION SELECT name || ' ' || city FROM clients WHERE client_id % 7 = 0 AND name IS NOT NULL AND city IS NOT NULL
    UNION SELECT name || ' ' || substr(city, 2, 3) || 'X' FROM clients WHERE client_id % 7 = 0 AND length(city) >= 5 AND name IS NOT NULL UNION SELECT substr(name, 1, 1) FROM vendors WHERE name IS NOT NULL UNION SELECT '  '"""


def _fold(s: str) -> str:
    return f"lower(regexp_replace(replace({s}, '台', '臺'), '\\s', '', 'g'))"


SEARCH = f"""WITH n AS ({NAMES}), q AS (SELECT query, {_fold("query")} AS v FROM ({QUERIES})), a AS (SELECT {_fold("alias")} AS alias, {_fold("name")} AS formal FROM n WHERE alias IS NOT NULL),
r AS (SELECT client_id AS slug, {_fold("coalesce(name, '') || coalesce(city, '') || coalesce(segment, '')")} AS hay, CAST(epoch(updated_at) AS BIGINT) AS start, CAST(epoch(updated_at) AS BIGINT) + client_id % 40 * 86400 AS e FROM clients),
w AS (SELECT query, v AS needle FROM q UNION SELECT query, substr(v, 1, strpos(v, alias) - 1) || formal || substr(v, strpos(v, alias) + length(alias)) FROM q JOIN a ON contains(v, alias)),
h AS (SELECT DISTINCT query, slug, start, e FROM w JOIN r ON contains(hay, needle) WHERE needle <> ''),
b AS (SELECT *, CASE WHEN e < {NOW} THEN 2 WHEN start < {NOW} THEN 0 ELSE 1 END AS band FROM h),
o AS (SELECT query, slug, start, count(*) OVER (PARTITION BY query) AS found, row_number() OVER (PARTITION BY query ORDER BY band, CASE band WHEN 0 THEN e WHEN 1 THEN start ELSE -start END NULLS FIRST, slug) AS rank FROM b)
SELECT query, CAST(found AS BIGINT) AS found, CAST(rank AS INTEGER) AS rank, slug, start FROM o WHERE rank <= 40"""

VENUES = f"""WITH n AS ({NAMES}), q AS (SELECT query, {_fold("query")} AS v FROM ({QUERIES})), k AS (SELECT name, slug, {_fold("name")} AS key FROM n UNION SELECT name, slug, {_fold("alias")} FROM n WHERE alias IS NOT NULL),
h AS (SELECT DISTINCT query, name, slug FROM q JOIN k ON contains(key, v) OR (length(v) >= 2 AND contains(v, key)) WHERE v <> '')
SELECT query, CAST(rank AS INTEGER) AS rank, name, slug FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY name, slug) AS rank FROM h) WHERE rank <= 6"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("clients", "client_changes", "vendors"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"search_{name}")
    own = lambda sql: spark.sql(sql.replace("FROM client_changes", "FROM search_client_changes").replace("FROM clients", "FROM search_clients").replace("FROM vendors", "FROM search_vendors"))
    names = own(NAMES).select("name", "slug", F.col("name").alias("position"), F.array_compact(F.array("alias")).alias("aliases"))
    return names, own(QUERIES)


@query("q25_search_terms", SEARCH)
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client is indexed; all queries run at once."""
    start = F.unix_seconds(F.col("updated_at").cast("timestamp"))
    rows = table(spark, sf_dir, "clients").select(F.col("client_id").alias("slug"), F.col("name").alias("title"), F.col("city").alias("venue"), F.col("segment").alias("city"), F.lit(None).cast("string").alias("cat"), start.alias("start"), (start + F.col("client_id") % 40 * 86_400).alias("end"))
    names, asked = _inputs(spark, sf_dir)
    index = search.Index.build(rows, storage.fresh(spark, "search-index"), NOW)
    return search.search(index, asked, names)


@query("q25_search_venues", VENUES)
def search_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, asked = _inputs(spark, sf_dir)
    return search.search_venues(asked, names)
