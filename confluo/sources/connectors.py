"""Bronze to observations: one declarative mapping for each source, isolated runs, and the quirks that several share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..operators.lifecycle import content_hash
from . import catalogue, readers


@dataclass
class Mapping:
    """Payload columns of one source, as expressions over its bronze columns."""

    source: str
    record_id: Column
    columns: dict[str, Column]
    keep: Column | None = None
    entity: Column | None = None
    schema: str | None = None
    tag: str = "item"
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        kind = catalogue.BY_ID[self.source].format
        if kind == "csv":
            return readers.read_csv(spark, path)
        if kind == "xml":
            return readers.read_flat_xml(spark, path, self.tag, self.schema)
        return readers.read_json_array(spark, path, self.schema)

    def apply(self, bronze: DataFrame, day: Column) -> DataFrame:
        """id, source, source_record_id, entity_kind, observed_at, content_hash and the payload columns."""
        rows = self.prepare(bronze) if self.prepare else bronze
        rows = rows.where(self.keep) if self.keep is not None else rows
        entity = self.entity if self.entity is not None else F.lit(catalogue.BY_ID[self.source].entity)
        rid = self.record_id.cast("string")
        out = rows.select(F.concat(F.lit(f"{self.source}:"), rid).alias("id"), F.lit(self.source).alias("source"), rid.alias("source_record_id"), entity.alias("entity_kind"), day.alias("observed_at"), *(c.alias(n) for n, c in self.columns.items()))
        return out.withColumn("content_hash", content_hash(*self.columns))


def run_all(spark: SparkSession, mappings: Iterable[Mapping], path_of: Callable[[str], str], day: Column, only: str = "") -> tuple[DataFrame | None, dict[str, str]]:
    """(all observations, failures by source): a source that cannot be read does not stop the others."""
    every, failed = None, {}
    for m in mappings:
        if only and only not in m.source:
            continue
        try:
            rows = m.apply(m.read(spark, path_of(m.source)), day)
        except Exception as e:  # noqa: BLE001 - reported by source
            failed[m.source] = str(e).splitlines()[0]
            continue
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    return every, failed


# --- quirks -----------------------------------------------------------------------------------------------------------


def wall_clock_shift(moment: Column) -> Column:
    """Moments marked as UTC that are local wall clock: the same digits in UTC+8."""
    shifted = F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(moment, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.when(shifted.isNotNull(), F.concat(F.substring(moment, 1, 19), F.lit(dates.ZONE))).otherwise(moment)


def without_sentinel(start: Column, end: Column) -> Column:
    """struct<start, end> as days where the times of day stand for none."""
    fake = dates.is_sentinel_range(F.substring(start, 12, 5), F.substring(end, 12, 5))
    cut = lambda c: F.when(fake, F.substring(c, 1, 10)).otherwise(c)
    return F.struct(cut(start).alias("start"), cut(end).alias("end"))


def explicit_free(price: Column) -> Column:
    """True only for a price text that says so; null otherwise."""
    return F.when(F.rlike(price, F.lit(r"^\s*(免費|自由入場|免票|free)")), F.lit(True))


def truth(value: Column) -> Column:
    """Yes and no in several spellings; null for anything else."""
    v = F.lower(text.trim_space(value))
    return F.when(v.isin("是", "y", "yes", "true", "1", "開放"), True).when(v.isin("否", "n", "no", "false", "0", "不開放"), False)


def with_default_venue(rows: DataFrame, venue: dict, hall: str = "hall") -> DataFrame:
    """Fill the place of sessions of a house that reports its own programme.

    A hall that names another city, or another institution, is off-site: it keeps only its own name. Otherwise missing
    fields come from the hall's entry or the house, and the name is the house's, with the hall behind it unless it is there.
    """
    name, halls = F.lit(venue["name"]), venue.get("halls", {})
    known = F.col(hall).isin(*halls) if halls else F.lit(False)
    city = geo.normalize_city(F.col(hall), allow_bare=True)
    other = F.nullif(F.regexp_extract(F.col(hall), r"((?:國立|國家|市立|縣立)[^\s、，,/／]{2,12}?(?:館|中心|院))", 1), F.lit(""))
    elsewhere = F.coalesce(city != F.lit(venue.get("city")), F.lit(False)) | F.coalesce(~F.contains(name, other) & ~F.contains(other, name), F.lit(False))
    off = ~F.coalesce(known, F.lit(False)) & elsewhere
    shown = F.when(F.col(hall).isNull(), name).when(F.contains(F.col(hall), name), F.col(hall)).otherwise(F.concat(name, F.col(hall)))
    rows = rows.withColumn("_off", off).withColumn("venue_name_raw", F.when(off, F.col(hall)).otherwise(F.coalesce("venue_name_raw", shown)))
    for key in ("lat", "lng", "city", "district", "address"):
        given = F.lit(venue.get(key))
        for hall_name, entry in halls.items():
            if key in entry:
                given = F.when(F.col(hall) == hall_name, F.lit(entry[key])).otherwise(given)
        rows = rows.withColumn(key, F.when(F.col("_off"), F.when(F.lit(key == "city"), city.cast(dict(rows.dtypes)[key])) if key == "city" else F.col(key)).otherwise(F.coalesce(key, given.cast(dict(rows.dtypes)[key]))))
    return rows.drop("_off")
