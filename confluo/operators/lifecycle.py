"""The append-only observation log: hashing, merging, tombstones, ids and small shaping operators."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def content_hash(*columns: str, digits: int = 16) -> Column:
    """The first digits of the SHA-256 of the columns as JSON, in their order; nulls are left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, digits)


def scd_merge(previous: DataFrame, current: DataFrame, key: str, day: Column) -> DataFrame:
    """Merge a snapshot (key, content_hash, payload) into the log; nothing is deleted.

    previous has also first_observed_at, last_verified_at, last_changed_at and disappeared_at. The status tells what
    happened: added, changed, same or gone. A tombstone keeps its first day and goes when the record comes back.
    """
    p, c = previous.alias("p"), current.alias("c")
    both = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full")
    here, was = F.col(f"c.{key}").isNotNull(), F.col(f"p.{key}").isNotNull()
    status = F.when(~was, "added").when(~here, "gone").when(F.col("p.content_hash") == F.col("c.content_hash"), "same").otherwise("changed")
    return both.select(
        F.coalesce(f"c.{key}", f"p.{key}").alias(key),
        status.alias("status"),
        F.coalesce("c.content_hash", "p.content_hash").alias("content_hash"),
        F.coalesce("c.payload", "p.payload").alias("payload"),
        F.coalesce("p.first_observed_at", day).alias("first_observed_at"),
        F.when(here, day).otherwise(F.col("p.last_verified_at")).alias("last_verified_at"),
        F.when(status.isin("added", "changed"), day).otherwise(F.col("p.last_changed_at")).alias("last_changed_at"),
        F.when(here, None).otherwise(F.coalesce("p.disappeared_at", day)).alias("disappeared_at"),
    )


def validated(records: DataFrame, required: list[str], entity: str = "entity_kind") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the names of the missing fields); events also need a session."""
    missing = [F.when(F.coalesce(text.trim_space(F.col(c).cast("string")), F.lit("")) == "", c) for c in required]
    if "sessions" in records.columns:
        missing.append(F.when((F.col(entity) == "event") & (F.coalesce(F.size("sessions"), F.lit(0)) < 1), "sessions"))
    marked = records.withColumn("missing", F.concat_ws("/", *missing))
    return marked.where("missing = ''").drop("missing"), marked.where("missing <> ''")


def recycled_ids(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(base, seq, id): the log id of each record of this run (base, seq, title), given the log (id, title).

    A record keeps the id of its family (base, base~2, ...) whose title names the same thing and is not taken yet in this
    run; else it gets the next number. Families are small; each is decided in order of seq.
    """
    old = previous.select(F.substring_index("id", "~", 1).alias("base"), "id", F.col("title").alias("title"), F.lit(0).alias("seq"), F.lit(True).alias("old"))
    new = current.select("base", F.lit(None).cast("string").alias("id"), "title", F.col("seq").cast("int").alias("seq"), F.lit(False).alias("old"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        base, family = pdf["base"].iloc[0], sorted(zip(pdf.loc[pdf.old, "id"], pdf.loc[pdf.old, "title"]))
        taken, rows = set(), []
        for seq, title in sorted(zip(pdf.loc[~pdf.old, "seq"], pdf.loc[~pdf.old, "title"])):
            found = next((i for i, t in family if i not in taken and same_thing(t, title)), None)
            if found is None:
                numbers = [int(i.partition("~")[2] or 1) for i in {*taken, *(i for i, _ in family)}]
                found = f"{base}~{max(numbers) + 1}" if numbers else base
            taken.add(found)
            rows.append((base, seq, found))
        return pd.DataFrame(rows, columns=["base", "seq", "id"])

    return old.unionByName(new).groupBy("base").applyInPandas(decide, "base string, seq int, id string")


def same_thing(a: str | None, b: str | None) -> bool:
    """The rule of functions.text.same_thing for two strings."""
    import unicodedata

    def plain(t: str | None) -> str:
        return "".join(c for c in (t or "").lower() if not c.isspace() and unicodedata.category(c)[0] not in "PS")

    x, y = plain(a), plain(b)
    if not x or not y or x in y or y in x:
        return True
    p, q = {x[i : i + 2] for i in range(len(x) - 1)}, {y[i : i + 2] for i in range(len(y) - 1)}
    return bool(p and q) and 2 * len(p & q) / (len(p) + len(q)) >= 0.5


def stable_ids(records: DataFrame, key: Column, order: str, legacy: DataFrame | None = None) -> DataFrame:
    """Records with an id from their content: a hash of the key, numbered where keys repeat; legacy (key, id) comes first."""
    n = F.row_number().over(W.partitionBy("_k").orderBy(order))
    rows = records.withColumn("_k", key).withColumn("_n", n).withColumn("_key", F.when(F.col("_n") > 1, F.concat("_k", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("_k")))
    fresh = F.concat(F.lit("k"), F.substring(F.sha2("_key", 256), 1, 12))
    if legacy is None:
        return rows.withColumn("record_id", fresh).drop("_k", "_n", "_key")
    rows = rows.join(legacy.selectExpr("key as _key", "id as _old"), "_key", "left")
    return rows.withColumn("record_id", F.coalesce("_old", fresh)).drop("_k", "_n", "_key", "_old")


def fill_from_group(rows: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Nulls of merged cells take the first value of their whole group."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumns({c: F.coalesce(c, F.first(c, ignorenulls=True).over(w)) for c in columns})


def keep_first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def nested_sessions(rows: DataFrame, key: str, order: str, fields: list[str], session: list[str]) -> DataFrame:
    """One record for each key: fields of its first row and all sessions in order."""
    first = F.min_by(F.struct(*fields), F.col(order)).alias("f")
    return rows.groupBy(key).agg(first, F.array_sort(F.collect_list(F.struct(order, *session))).alias("sessions")).select(key, "f.*", "sessions")


def union_with_previous(previous: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Both, where fresh rows win."""
    return previous.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def changes(previous: DataFrame, current: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, keys to delete): those whose content_hash is new, and those that are gone."""
    same = current.join(previous.select(key, "content_hash"), [key, "content_hash"], "left_semi").select(key)
    return current.join(same, key, "left_anti"), previous.select(key).join(current.select(key), key, "left_anti")


def first_write_wins(registry: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Append rows whose key is not registered yet: of several with one key the first by ``order``, then by all columns."""
    single = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order, *rows.columns)).alias("r")).select("r.*")
    return registry.unionByName(single.join(registry.select(key), key, "left_anti"))


def per_value(rows: DataFrame, columns: list[str], value: Column, name: str) -> DataFrame:
    """Rows with a column ``name`` that holds an expression over ``columns``, worked out once for each of their distinct values.

    For expressions that cost far more than a shuffle of the row; nulls are values too.
    """
    made = rows.select(*columns).distinct().select(*(F.col(c).alias(f"_of_{c}") for c in columns), value.alias(name))
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns))
    return rows.join(made, same, "left").select(*rows.columns, name)
