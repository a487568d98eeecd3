"""Bronze readers: NDJSON, JSON with byte-order marks, CSV, flat XML, JSON inside ZIP files, HTML blocks and feeds."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"

OBSERVATION = (
    "id string, source string, source_record_id string, entity_kind string, content_hash string, first_observed_at date, last_verified_at date, last_changed_at date, disappeared_at date, "
    "source_updated_at string, payload struct<title: string, name: string, source_name: string, source_url: string, description: string, category_raw: string, status: string, price_text: string, "
    "ticket_url: string, is_free: boolean, popularity: double, minimum_age: int, external_ids: map<string, string>, tags_raw: array<string>, images: array<struct<url: string, caption: string>>, "
    "performers: array<struct<name_raw: string, country: string>>, organizers: array<struct<name_raw: string, role: string>>, sessions: array<struct<start_at: string, end_at: string, granularity: string, "
    "on_sales: boolean, venue_name_raw: string, address: string, address_precision: string, city: string, district: string, city_code: string, district_code: string, lat: double, lng: double>>, "
    "address: string, address_precision: string, city: string, district: string, city_code: string, district_code: string, lat: double, lng: double, phone: string, email: string, website: string, "
    "opening_hours_raw: string, act_type: string, theme: string, license_city: string, person_type: string, org_type: string, registration_no: string, competent_authority: string, founded_at: string, "
    "level: string, heritage_types: array<struct<code: string, name: string>>, history: string, registered_at: string, gov_institution: string, is_open_visit: boolean, open_visit_text: string, is_charge: boolean>"
)


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped. ``source`` of a row without one is its file's name."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if "source" not in rows.columns:
        return rows
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.(?:ndjson|json|jsonl)", 1)
    return rows.withColumn("source", F.coalesce("source", F.nullif(name, F.lit(""))))


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The same, and an empty table where nothing is stored yet."""
    try:
        return read_ndjson(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def without_boms(body: Column) -> Column:
    """JSON text without byte-order marks at its start and at the start of keys; values keep theirs."""
    s = F.regexp_replace(body, f"^{BOM}+", "")
    return F.regexp_replace(s, rf'([{{,]\s*"){BOM}+([^"\\]*"\s*:)', "$1$2")


def read_json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Rows of files that hold one JSON array each, tolerant of byte-order marks."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.explode(F.from_json(without_boms(F.col("value")), f"array<{element}>")).alias("r"))
    return rows.select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, doubled quotes and line breaks inside quotes; short rows are filled with empty strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    rows = rows.toDF(*[c.lstrip(BOM) for c in rows.columns])
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes))


def read_flat_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Items without attributes or nesting; all other tags are ignored."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def xml_items(body: Column, tag: str, fields: list[str]) -> Column:
    """array<struct> of the items of malformed feeds, by pattern."""
    items = F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))

    def value(item: Column, name: str) -> Column:
        raw = F.regexp_extract(item, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    return F.transform(items, lambda x: F.struct(*(F.nullif(value(x, f), F.lit("")).alias(f) for f in fields)))


def html_blocks(body: Column, pattern: str, fields: dict[str, str]) -> Column:
    """array<struct> of the blocks that ``pattern`` (one group) finds; each field is the first group of its own pattern."""
    blocks = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    return F.transform(blocks, lambda x: F.struct(*(F.nullif(F.trim(F.regexp_extract(x, p, 1)), F.lit("")).alias(n) for n, p in fields.items())))


def read_zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(file, member, body) of the text members of ZIP files, stored or deflated; one file at a time is in memory."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(suffix):
                            cols = [pa.array([v]) for v in (name, member, z.read(member).decode("utf-8-sig"))]
                            yield pa.RecordBatch.from_arrays(cols, names=["file", "member", "body"])

    return files.mapInArrow(run, "file string, member string, body string")


def not_stale(files: DataFrame, state: DataFrame) -> DataFrame:
    """Raw files (source, sha256, modified) that are not older than what the schedule (source, content_hash, last_fetched_at) knows."""
    both = files.join(state, "source", "left")
    return both.where("content_hash is null or last_fetched_at is null or sha256 = content_hash or modified >= last_fetched_at").select(*files.columns)
