"""Document fingerprints from closed syncmers over words, with DataFrame functions only.

A k-mer (K words in a row) is chosen if the smallest hash of its inner s-mers (S words in a row) is the first or the last
one. That depends on the k-mer alone, so equal passages give equal anchors wherever they stand. The fingerprint of a text
keeps the SKETCH smallest hashes of its distinct anchors; the likeness of two fingerprints estimates the Jaccard similarity
of the anchor sets, and is exact for sets of up to SKETCH anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_per_id, range_of, ranges, split_points

K, S, SKETCH = 5, 2, 64
#: Words are the runs of characters other than ASCII white space.
SPLIT = r"[ \t\n\x0B\f\r]+"


def _let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def anchors_sql(text: str) -> str:
    """SQL for array<struct<pos, hash>>: first word and hash of each chosen k-mer of a text, in order.

    A text of fewer than K words has one anchor made of all its words; one without words has none.
    """
    n = K - S + 1
    smer = ", ".join(f"h[i + {j}]" for j in range(S))
    edges = f"least(m[i], m[i + {n - 1}])"
    inner = f"least({', '.join(f'm[i + {j}]' for j in range(1, n - 1))})" if n > 3 else (f"m[i + 1]" if n == 3 else edges)
    kmer = ", ".join(f"h[i + {j}]" for j in range(K))
    chosen = f"filter(sequence(0, size(h) - {K}), i -> {edges} <= {inner})"
    many = _let(f"transform(sequence(0, size(h) - {S}), i -> xxhash64({smer}))", "m", f"transform({chosen}, i -> named_struct('pos', i, 'hash', shiftrightunsigned(xxhash64({kmer}), 16)))")
    few = "if(size(h) = 0, cast(array() as array<struct<pos: int, hash: bigint>>), array(named_struct('pos', 0, 'hash', shiftrightunsigned(xxhash64(concat_ws(' ', transform(h, x -> hex(x)))), 16))))"
    words = f"filter(split({text}, '{SPLIT}'), w -> w <> '')".replace("\\", "\\\\")
    return _let(f"transform({words}, w -> xxhash64(w))", "h", f"if(size(h) >= {K}, {many}, {few})")


def sketch_sql(text: str) -> str:
    """SQL for the sorted SKETCH smallest distinct anchor hashes of a text."""
    return f"slice(sort_array(array_distinct(transform({anchors_sql(text)}, a -> a.hash))), 1, {SKETCH})"


def likeness_sql(a: str, b: str) -> str:
    """SQL for the estimated Jaccard similarity of two sketches; two empty ones are alike."""
    union = f"slice(sort_array(array_union({a}, {b})), 1, {SKETCH})"
    return f"if(size({a}) = 0 and size({b}) = 0, 1.0d, " + _let(union, "u", f"size(array_intersect(u, array_intersect({a}, {b}))) / size(u)") + ")"


def print_sql(sketch: str) -> str:
    return f"concat_ws('', transform({sketch}, x -> lpad(lower(hex(x)), 12, '0')))"


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, hash) of every anchor, for positional matching."""
    found = docs.selectExpr("doc_id", f"{anchors_sql("coalesce(text, '')")} as a")
    return found.selectExpr("doc_id", "inline(a)")


def passages(docs: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, other_id, shift, n, first_pos): where anchors of two tables of texts match in position.

    Anchors of equal hash whose places differ by the same shift belong to one alignment; n counts them, from first_pos on.
    Repeated anchors of a text are matched in turn, the k-th with the k-th, so a repetitive text makes no more rows than it
    has anchors. Meant for a bounded set of searched texts, or pairs found before: a hash that many texts of both tables
    hold pairs them all. Null ids match nothing.
    """
    turn = W.partitionBy("doc_id", "hash").orderBy("pos")
    mine, theirs = (anchors(d.where("doc_id is not null").select("doc_id", "text").distinct()).withColumn("turn", F.row_number().over(turn)) for d in (docs, other))
    both = mine.join(theirs.selectExpr("doc_id as other_id", "pos as other_pos", "hash", "turn"), ["hash", "turn"])
    return both.groupBy("doc_id", "other_id", (F.col("other_pos") - F.col("pos")).alias("shift")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the sketch of every row (null text: as the empty one)."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text").selectExpr("doc_id", "length(text) as n", f"{sketch_sql('text')} as sketch")


def with_next(rows: DataFrame, made: dict[str, str], columns: list[str]) -> DataFrame:
    """Rows (one for each doc_id) with the columns ``made`` (SQL) and ``next_<column>``: the value of the next larger doc_id.

    After the largest doc_id follows the smallest.

    Ids are cut at approximate quantiles into ranges, as many as the table's size asks for, each dealt to its own task. The
    first row of each range is also put behind the end of the range before it; these are as many rows as ranges.
    """
    points = split_points(rows.select("doc_id"), "doc_id", ranges(rows))
    part = range_of("doc_id", points).cast("int")
    heads = rows.select("doc_id").withColumn("part", part).groupBy("part").agg(F.min("doc_id").alias("doc_id"))
    before = heads.selectExpr("doc_id", "coalesce(lag(part) over (order by part), max(part) over ()) as part")  # a row for each range
    extra = rows.join(F.broadcast(before), "doc_id").withColumn("_extra", F.lit(True))
    every = rows.withColumn("part", part).withColumn("_extra", F.lit(False)).unionByName(extra)
    dealt = every.repartitionById(len(points) + 1, "part")  # the texts are shuffled once, without what is made of them
    for name, sql in made.items():
        dealt = dealt.withColumn(name, F.expr(sql))
    order = W.partitionBy("part").orderBy("_extra", "doc_id")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_extra")).drop("part", "_extra")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprint every document and its edited text: the last half replaced by as much of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The next document is
    that of the next larger doc_id, after the largest that of the smallest. Rows of one doc_id are one document with the
    smallest of their texts; a null text is empty. Rows without doc_id have no next document: they keep n_chars and
    fingerprint, and the other columns are null. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    known, lone = one_per_id(docs), docs.where("doc_id is null")
    rows = with_next(known, {"n": "length(text)", "sketch": sketch_sql("text")}, ["text", "sketch"])
    rows = rows.selectExpr("doc_id", "n", "sketch", "next_sketch", "concat(substring(text, 1, cast(n - n div 2 as int)), substring(next_text, 1, cast(n div 2 as int))) as edited")
    rows = rows.selectExpr("doc_id", "n", "sketch", "next_sketch", "sha2(edited, 256) as edited_sha256", f"{sketch_sql('edited')} as edited_sketch")
    shown = rows.selectExpr(
        "doc_id", "cast(n as long) as n_chars", "edited_sha256", f"{print_sql('sketch')} as fingerprint", f"{print_sql('edited_sketch')} as edited_fingerprint",
        f"{likeness_sql('sketch', 'edited_sketch')} as near_edited", f"{likeness_sql('sketch', 'next_sketch')} as near_next",
    )
    alone = fingerprints(lone).selectExpr(
        "doc_id", "cast(n as long) as n_chars", "cast(null as string) as edited_sha256", f"{print_sql('sketch')} as fingerprint", "cast(null as string) as edited_fingerprint",
        "cast(null as double) as near_edited", "cast(null as double) as near_next",
    )
    return shown.union(alone)
