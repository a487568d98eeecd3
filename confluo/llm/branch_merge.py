"""Three-way merge of two branches of a document table, with native expressions inside each row.

A branch is a rule that gives every row, column and line of the base an edit. Lines are merged where they lie: the text is
split, its lines are transformed with their index into merged states, counters are aggregated over these, and what is left
is flattened, joined and hashed. No line becomes a row of its own, so a merge of texts needs no shuffle; only rows that
branches add are grouped by their new id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits. A row or a line can be dropped; a line or a column can get an ending; behind a line a new one can stand, and
#: beside a row a new row. A column is not dropped but emptied. Any other number is no edit.
DROP, MARK, ASK, ADD_MARK, ADD_ASK = range(5)
CHOICES = 11
ENDINGS = {MARK: "!", ASK: "?"}
ADDITIONS = {ADD_MARK: "!", ADD_ASK: "?"}
COLUMNS = ("lang", "source")
COUNTERS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")

#: (branch, doc_id, name of the row, column or line) -> edit
Rule = Callable[[str, Column, Column], Column]


def by_checksum(branch: str, doc_id: Column, name: Column) -> Column:
    """The edit crc32(`branch:doc_id:name`) modulo CHOICES; none where doc_id is null."""
    key = F.concat(F.lit(f"{branch}:"), doc_id.cast("string"), F.lit(":"), name)
    return F.coalesce(F.crc32(key.cast("binary")) % CHOICES, F.lit(CHOICES))


def _whether(condition: Column) -> Column:
    return condition.cast("long")


def _ended(value: Column, edit: Column, dropped: Column) -> Column:
    found = F.when(edit == DROP, dropped)
    for number, ending in ENDINGS.items():
        found = found.when(edit == number, F.concat(value, F.lit(ending)))
    return found.otherwise(value)


def _line(state: Column) -> Column:
    """What becomes of a line and of the gap behind it, which counters that adds to, and which branch changes something."""
    left, right, same = state["left"], state["right"], state["left"] == state["right"]
    edits = [left <= ASK, right <= ASK]
    adds = [e.isin(*ADDITIONS) for e in (left, right)]
    clash, gap_clash = edits[0] & edits[1] & ~same, adds[0] & adds[1] & ~same

    def chosen(changes: list[Column], conflict: Column) -> Column:
        return F.when(conflict, F.lit(CHOICES)).when(changes[0], left).when(changes[1], right).otherwise(F.lit(CHOICES))

    added = chosen(adds, gap_clash)
    gap = F.when(added == ADD_MARK, ADDITIONS[ADD_MARK]).when(added == ADD_ASK, ADDITIONS[ADD_ASK])
    dropping = (left == DROP) | (right == DROP)
    return F.struct(
        F.array_compact(F.array(_ended(state["line"], chosen(edits, clash), F.lit(None).cast("string")), gap)).alias("lines"),
        (_whether((edits[0] | edits[1]) & ~clash) + _whether((adds[0] | adds[1]) & ~gap_clash)).alias("n_clean"),
        _whether(clash & ~dropping).alias("n_edit_edit"),
        _whether(clash & dropping).alias("n_edit_delete"),
        _whether(gap_clash).alias("n_insert_insert"),
        (edits[0] | adds[0]).alias("by_left"),
        (edits[1] | adds[1]).alias("by_right"),
    )


def _totals(states: Column) -> Column:
    """Counters over all lines, and whether either branch changes one."""
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTERS], F.lit(False).alias("by_left"), F.lit(False).alias("by_right"))

    def add(sums: Column, state: Column) -> Column:
        flags = [(sums[c] | state[c]).alias(c) for c in ("by_left", "by_right")]
        return F.struct(*[(sums[c] + state[c]).alias(c) for c in COUNTERS], *flags)

    return F.aggregate(states, start, add)


def _column(value: Column, left: Column, right: Column) -> Column:
    """A column merged by value: an edit that leaves the value as it is is none."""
    a, b = (_ended(value, edit, F.lit("")) for edit in (left, right))
    by_left, by_right = a != value, b != value
    clash = by_left & by_right & (a != b)
    return F.struct(
        F.when(by_left & ~clash, a).when(by_right & ~clash, b).otherwise(value).alias("value"),
        _whether((by_left | by_right) & ~clash).alias("n_clean"),
        _whether(clash).alias("n_edit_edit"),
        by_left.alias("by_left"),
        by_right.alias("by_right"),
    )


def _base_rows(docs: DataFrame) -> DataFrame:
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*COLUMNS, "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *empty)


def _kept_rows(base: DataFrame, branches: tuple[str, str], rule: Rule) -> DataFrame:
    """Every row of the base with what the branches make of it; ``present`` is false where it is dropped."""
    doc_id = F.col("doc_id")
    left, right = ((lambda name, b=b: rule(b, doc_id, name).cast("int")) for b in branches)

    def edits(line: Column, index: Column) -> Column:
        name = index.cast("string")
        return F.struct(line.alias("line"), left(name).alias("left"), right(name).alias("right"))

    rows = base.withColumn("states", F.transform(F.transform(F.split("text", "\n", -1), edits), _line))
    rows = rows.withColumn("totals", _totals(F.col("states")))
    for c in COLUMNS:
        rows = rows.withColumn(f"{c}_state", _column(F.col(c), left(F.lit(c)), right(F.lit(c))))
    parts = ["totals", *[f"{c}_state" for c in COLUMNS]]

    def any_change(branch: str) -> Column:
        return F.expr(" or ".join(f"{p}.by_{branch}" for p in parts))

    gone = [side(F.lit("row")) == DROP for side in (left, right)]
    rows = rows.withColumn(
        "fate",
        F.when(gone[0] & gone[1], "dropped")
        .when(gone[0], F.when(any_change("right"), "disputed").otherwise("dropped"))
        .when(gone[1], F.when(any_change("left"), "disputed").otherwise("dropped"))
        .otherwise("merged"),
    )
    merged, dropped, disputed = (F.col("fate") == f for f in ("merged", "dropped", "disputed"))

    def count(name: str, alone: Column, sums: list[str]) -> Column:
        total = sum((F.col(f"{p}.{name}") for p in sums[1:]), F.col(f"{sums[0]}.{name}"))
        return F.when(merged, total).otherwise(_whether(alone)).alias(name)

    joined = F.array_join(F.flatten("states.lines"), "\n")
    return rows.select(
        "doc_id",
        *[F.when(merged, F.col(f"{c}_state.value")).when(disputed, F.col(c)).alias(c) for c in COLUMNS],
        F.when(merged, joined).when(disputed, F.col("text")).alias("text"),
        count("n_clean", dropped, parts),
        count("n_edit_edit", F.lit(False), parts),
        count("n_edit_delete", disputed, ["totals"]),
        count("n_insert_insert", F.lit(False), ["totals"]),
    )


def _added_rows(base: DataFrame, branches: tuple[str, str], rule: Rule) -> DataFrame:
    """Rows that the branches add, merged by their new ids: -1 - doc_id of the first branch, -2 - doc_id of the second.

    Both sides are narrow rows of the base without its text. Of several rows that one branch adds under one id, as repeated
    rows of the base make it do, the smallest stands.
    """
    found = []
    for number, branch in enumerate(branches):
        edit = rule(branch, F.col("doc_id"), F.lit("row")).cast("int")
        text = F.when(edit == ADD_MARK, ADDITIONS[ADD_MARK]).when(edit == ADD_ASK, ADDITIONS[ADD_ASK])
        rows = base.select(F.try_subtract(F.lit(-1 - number).cast("long"), F.col("doc_id")).alias("doc_id"), text.alias("text"), *COLUMNS)
        value = F.struct("text", *COLUMNS)
        sides = [value if k == number else F.lit(None).cast(f"struct<text: string, {', '.join(f'{c}: string' for c in COLUMNS)}>") for k in (0, 1)]
        found.append(rows.where("text is not null and doc_id is not null").select("doc_id", sides[0].alias("a"), sides[1].alias("b")))
    both = found[0].union(found[1]).groupBy("doc_id").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    clash = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    value = F.when(~clash, F.coalesce("a", "b"))
    zero = F.lit(0).cast("long")
    return both.select(
        "doc_id",
        *[value[c].alias(c) for c in COLUMNS],
        value["text"].alias("text"),
        _whether(~clash).alias("n_clean"),
        zero.alias("n_edit_edit"),
        zero.alias("n_edit_delete"),
        _whether(clash).alias("n_insert_insert"),
    )


def merge(docs: DataFrame, branches: tuple[str, str] = ("L", "R"), rule: Rule = by_checksum) -> DataFrame:
    """The merge of two branches of ``docs``: doc_id, lang, source, text and the four counters, one row per id ever present.

    One-sided or equal changes are clean, others are conflicts, where the base's state stays. Columns and added rows are
    compared by value; lines and the gaps behind them, even behind dropped lines, are merged separately. A row that one
    branch drops and the other changes stays as it was, as one conflict of edit and delete; otherwise a drop is one clean
    change. An id that is absent from the merge has null lang, source and text.

    Nulls in text, lang and source become empty first. An empty text is one empty line; if all lines are dropped, the text
    is empty. Rows without a doc_id are in no branch's reach: they stay, unchanged. Repeated rows of the base are merged row
    by row, and what they add counts once. An added row whose id the base holds (only where doc_ids are negative) is a row
    of its own. Long texts are worked on within their row; an empty table gives an empty result; columns other than doc_id,
    text, lang and source are left out, whatever their names.
    """
    base = _base_rows(docs)
    return _kept_rows(base, branches, rule).union(_added_rows(base, branches, rule))


def digests(merged: DataFrame) -> DataFrame:
    """The merge with text_sha256 in place of the text, null where the row is absent."""
    return merged.select("doc_id", *COLUMNS, F.sha2("text", 256).alias("text_sha256"), *COUNTERS)
