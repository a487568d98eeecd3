"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Each mask is a fixed pattern over a window of words: positions marked 1 are hashed, the others are ignored, so a seed
still hits where ignored words were substituted. Seeds of the documents are joined with those of the benchmark; around the
hits, document and item are compared word by word along the diagonal, and the matched item words of all diagonals count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Of every item of LEAST_WORDS words and more that keeps COVERAGE of its words in place, at least one window of these masks
#: is whole, and at least two of an item of SURE_WORDS and more; tests try all substitutions of the short ones.
MASKS = ("1101", "10011")
LEAST_WORDS, SURE_WORDS = 5, 11
#: Share of an item's words, or number of them, that must match.
COVERAGE = 0.7
LONG_MATCH = 20
#: A join side is broadcast up to so many bytes, after counting; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20

#: Words are the runs of letters and digits, in lower case.
WORDS = "filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')"


def _terms(mask: str) -> list[str]:
    """What a seed hashes: word hashes h and, where two marked positions are neighbours, hashes p of pairs."""
    out, j = [], 0
    while j < len(mask):
        pair = mask[j : j + 2] == "11"
        if mask[j] == "1":
            out.append(f"{'p' if pair else 'h'}[i + {j}]")
        j += 2 if pair else 1
    return out


def seeds_sql(hashes: str, masks: tuple[str, ...] = MASKS) -> str:
    """SQL for array<array<seed>> of an array of word hashes: for each mask its seeds at all positions, in order.

    An array shorter than a mask gives none of it.
    """
    parts = []
    for number, mask in enumerate(masks):
        many = f"transform(sequence(0, size(h) - {len(mask)}), i -> xxhash64({number}, {', '.join(_terms(mask))}))"
        parts.append(f"if(size(h) >= {len(mask)}, {many}, cast(array() as array<bigint>))")
    pairs = "transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1]))"
    whole = f"transform(array(if(size(h) >= 2, {pairs}, array())), p -> array({', '.join(parts)}))[0]"
    return f"transform(array({hashes}), h -> {whole})[0]"


def seeds(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, seed) of the column text of every row."""
    found = rows.select(key, "text").where("text is not null").selectExpr(key, f"explode({seeds_sql(f'transform({WORDS}, w -> xxhash64(w))')}) as s")
    return found.selectExpr(key, "posexplode(s) as (pos, seed)")


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (distinct item words found in place), item_words, first_word and covered.

    One row for each document and item whose matched words are at least COVERAGE of the item's words, or LONG_MATCH of
    them. The words of a diagonal count if one seed hits there, or two for items of SURE_WORDS words and more. Items of fewer
    than LEAST_WORDS words are not looked for: most texts hold them by chance. Null texts and ids match nothing; repeated
    rows of a document or item count once. Other columns are ignored; an empty table gives no rows. The benchmark's seeds are
    broadcast if they are counted to be few; no pairs of documents arise, so a frequent passage costs as many rows as
    documents hold it.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("doc_id is not null")
    items = benchmark.selectExpr("cast(item_id as long) as item_id", "text").where("item_id is not null and text is not null").distinct()
    items = written(items.selectExpr("item_id", "text", f"{WORDS} as item").where(f"size(item) >= {LEAST_WORDS}"), "items")
    keys = seeds(items, "item_id").withColumnRenamed("pos", "item_pos").distinct()
    needed = items.groupBy("item_id").agg(F.when(F.max(F.size("item")) >= SURE_WORDS, 2).otherwise(1).alias("needed"))
    n_keys, n_items, n_words = keys.count(), *items.agg(F.count("*"), F.coalesce(F.sum(F.size("item")), F.lit(0))).first()
    hits = seeds(docs, "doc_id").join(_small(keys, 24 * n_keys), "seed").selectExpr("doc_id", "item_id", "pos - item_pos as shift")
    counted = hits.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("n"))  # counted in each task before the shuffle
    diagonals = counted.join(_small(needed, 16 * n_items), "item_id").where("n >= needed").select("doc_id", "item_id", "shift")
    diagonals = written(diagonals, "diagonals")
    n = diagonals.count()
    # what each diagonal asks of the document, word by word, and the words of the documents that are asked
    asked = diagonals.join(_small(items.selectExpr("item_id", "size(item) as item_words", "item"), 32 * n_words), "item_id")
    asked = asked.selectExpr("doc_id", "item_id", "item_words", "shift", "posexplode(item) as (at, word)").selectExpr("doc_id", "item_id", "item_words", "at", "shift + at as pos", "word").where("pos >= 0")
    words = docs.join(_small(diagonals.select("doc_id").distinct(), 8 * n), "doc_id", "left_semi").selectExpr("doc_id", f"posexplode({WORDS}) as (pos, word)")
    found = asked.join(words, ["doc_id", "pos", "word"]).select("doc_id", "item_id", "item_words", "at", "pos")
    rows = found.groupBy("doc_id", "item_id", "item_words").agg(F.count_distinct("at").alias("matched"), F.min("pos").alias("first_word"))
    rows = rows.where(f"matched >= {COVERAGE} * item_words or matched >= {LONG_MATCH}")
    return rows.selectExpr("doc_id", "item_id", "cast(matched as long) as matched", "cast(item_words as long) as item_words", "cast(first_word as long) as first_word", "round(matched / item_words, 6) as covered")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with all their columns; rows without a doc_id are kept."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("_leaked_doc_id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("_leaked_doc_id"), "left_anti")
