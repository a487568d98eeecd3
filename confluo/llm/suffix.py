"""Exact removal of repeated byte strings by a distributed difference-cover suffix sort.

Which suffixes have to be sorted together is decided by content, without loss: every string of LENGTH bytes has an anchor,
its k-gram of GRAM bytes with the smallest hash (the leftmost of equal ones). Equal strings have equal anchors, so strings
whose anchor occurs once are unique, and all others fall into independent groups by anchor. Within a group, anchors with
equal surroundings are settled at once: the first keeps its strings, the others repeat them. What is left, the distinct
surroundings of anchors that occur in several, is dealt to tasks by anchor (those of a frequent anchor by a second anchor of
each string, under another hash) and suffix-sorted there by the difference cover
modulo 3: sort the sampled triples, recurse on their names until they are distinct, sort the remaining suffixes by first
byte and following rank, and merge both. Suffixes that share LENGTH bytes are then neighbours, and comparing adjacent
prefixes gives the groups of equal strings; all but the first of each are removed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import mix, one_per_id, partitions, Rolling, text_slices, tidied, tune, written

LENGTH = 100
GRAM = 24
#: Bytes of surroundings that one suffix sort takes. A group beyond HEAVY_BYTES is cut by further anchors, LEVELS times at
#: most; strings that agree in all of these are compared by hash.
SORT_BYTES = 1 << 20
HEAVY_BYTES = 24 << 20
LEVELS = 6
#: An anchor with more distinct surroundings than this is cut by second anchors before it is dealt.
HOT_ROWS = 1_000
#: So many of these anchors are broadcast, after counting.
HOT_KEYS = 500_000

_U = np.uint64

# --- difference cover ------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of non-negative integers, sorted; an ended suffix precedes its continuations."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    letters, s = np.unique(s, return_inverse=True)
    k = len(letters) + 1
    t = np.zeros(n + 3, np.int64)
    t[:n] = s + 1
    # ranks of the sampled suffixes, at positions 1 and 2 modulo 3
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (t[sample] * k + t[sample + 1]) * k + t[sample + 2]
    names, name = np.unique(triples, return_inverse=True)
    if len(names) < len(sample):
        order = suffix_array(name)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    sample = sample[np.argsort(name)]
    sample = sample[sample < n]
    # the remaining suffixes, by first letter and the rank that follows
    rest = np.arange(0, n, 3)
    base = n + 2
    rest = rest[np.argsort(t[rest] * base + rank[rest + 1], kind="stable")]
    # merge: how many sampled suffixes of either kind precede each of the rest
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[one] * base + rank[one + 1], t[rest] * base + rank[rest + 1])
    keys = (t[two] * k + t[two + 1]) * base + rank[two + 2]
    before += np.searchsorted(keys, (t[rest] * k + t[rest + 1]) * base + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sample
    return out


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start its group: starts whose next ``length`` bytes are equal share a number. By adjacent prefixes."""
    order = suffix_array(text)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(np.diff(Rolling(text).of(order, order + length)) == 0) + 1
    for at in range(0, len(near), 1 << 15):
        some = near[at : at + (1 << 15)]
        a, b = order[some - 1][:, None] + np.arange(length), order[some][:, None] + np.arange(length)
        same[some] = (text[a] == text[b]).all(1)
    group = np.zeros(len(text), np.int64)
    group[order] = np.cumsum(~same)
    return group[starts]


# --- anchors -----------------------------------------------------------------------------------------------------------


def anchor_rows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, level: int = 0):
    """For each anchor: row, first string's start in its row, number of strings, anchor's distance, hash, surroundings' hash.

    The strings of ``length`` bytes that an anchor has start one after another; a row shorter than that has none. Each level
    picks anchors by another hash.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(_U), none.astype(_U)
    rolling = Rolling(data)
    at = np.arange(n - gram + 1)
    grams = rolling.of(at, at + gram)
    low = ((mix(grams ^ _U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if level else grams) >> _U(28) << _U(28)) | at.astype(_U)
    window, width = length - gram + 1, 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    anchor = (low & _U((1 << 28) - 1)).astype(np.int64)  # of the string at each position
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    count = np.bincount(run[valid], minlength=len(first)) if len(first) else none
    place = anchor[first]
    key = rolling.of(place, place + gram)
    around = rolling.of(first, first + count - 1 + length) ^ mix((count << 20 | place - first).astype(_U))
    return row[first], first - offsets[row[first]], count, place - first, key, mix(around)


ROWS = "key long, around long, doc_id long, start long, n int, back int"


def repeats_here(ids: np.ndarray, first: np.ndarray, key: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Whether an anchor with the same surroundings stands earlier among these."""
    order = np.lexsort((first, ids, around, key))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
    return later


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """One row per anchor of every text: its hash, that of its surroundings, and the strings it has.

    Where a slice of texts holds several with the same surroundings, only the first is dealt by its hash. The others are
    settled already; they have back = -1 and are dealt at random, so that a frequent passage does not gather in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                row, first, count, back, key, around = anchor_rows(data, offsets, length)
                ids = batch.column(0).slice(start, end - start).take(pa.array(row))
                later = repeats_here(ids.to_numpy(), first, key, around)
                key[later] = mix(around[later] + first[later].astype(_U) + ids.to_numpy()[later].astype(_U) * _U(0x9E3779B97F4A7C15))
                back[later] = -1
                cols = [pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), ids, pa.array(first), pa.array(count.astype(np.int32)), pa.array(back.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "around", "doc_id", "start", "n", "back"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), ROWS)


class _Groups:
    """Streams rows sorted by key, surroundings, doc_id and start; memory holds one batch."""

    def __init__(self):
        self.key = self.around = None
        self.held: pa.RecordBatch | None = None  # the first row of a key, while it is its only surrounding

    def step(self, batch: pa.RecordBatch) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        """Rows that repeat an earlier one entirely, and first rows of surroundings of keys that have several."""
        key, around = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new_key = np.r_[self.key is None or key[0] != self.key, key[1:] != key[:-1]]
        new = new_key | np.r_[self.around is None or around[0] != self.around, around[1:] != around[:-1]]
        repeats = [batch.take(pa.array(np.flatnonzero(~new)))]
        lead = np.flatnonzero(new)
        firsts: list[pa.RecordBatch] = []
        if len(lead):
            opens = new_key[lead]
            several = ~opens
            several[:-1] |= ~opens[1:]
            if not opens[0] and self.held is not None:
                firsts.append(self.held)
            if not opens[0] or opens.any():
                self.held = None
            firsts.append(batch.take(pa.array(lead[several])))
            if opens[-1]:
                self.held = batch.slice(lead[-1], 1)
        self.key, self.around = key[-1], around[-1]
        return repeats, firsts


SETTLED = "doc_id long, start long, n int, back int, key long, again boolean"


def settled(rows: DataFrame) -> DataFrame:
    """Anchors that repeat an earlier one with its surroundings (again), and the first ones of keys with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for batch in batches:
            done = batch.column(5).to_numpy() < 0
            rest = batch.take(pa.array(np.flatnonzero(~done)))
            again, firsts = groups.step(rest) if rest.num_rows else ([], [])
            for again, found in ((True, [batch.take(pa.array(np.flatnonzero(done))), *again]), (False, firsts)):
                for b in found:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), b.column(5), b.column(0), pa.array([again] * b.num_rows)], names=["doc_id", "start", "n", "back", "key", "again"])

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "around", "doc_id", "start")
    return dealt.mapInArrow(tidied(run), SETTLED)


PIECES = "key long, doc_id long, start long, n int, bytes binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "doc_id", "start", "n", "bytes"])


def divided(rows: list[tuple], length: int, level: int) -> list[tuple]:
    """Pieces (key, doc, start, n, bytes) cut by the anchors of their strings under another hash.

    Equal strings have equal anchors, so they meet under equal keys again; the key keeps what it said before.
    """
    if not rows:
        return []
    offsets = np.r_[0, np.cumsum([len(r[4]) for r in rows])]
    row, first, count, _, key, _ = anchor_rows(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), offsets, length, GRAM, level)
    before = np.array([r[0] for r in rows], np.int64).view(_U)[row]
    keys = mix(before ^ mix(key + _U(level))).view(np.int64)
    return [(k, rows[i][1], rows[i][2] + a, n, rows[i][4][a : a + n - 1 + length]) for k, i, a, n in zip(keys.tolist(), row.tolist(), first.tolist(), count.tolist())]


def surroundings(docs: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, start, n, bytes): the bytes that hold all strings of each of the anchors ``firsts``.

    Those of anchors with more than HOT_ROWS distinct surroundings are cut by second anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, doc, anchors = (batch.column(1)[k].as_py() or "").encode(), batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                rows = [(a["key"], doc, a["start"], a["n"], raw[a["start"] : a["start"] + a["n"] - 1 + length], a["hot"]) for a in anchors]
                yield _pieces([r[:5] for r in rows if not r[5]] + divided([r[:5] for r in rows if r[5]], length, 1))

    hot = firsts.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT_ROWS).select("key", F.lit(True).alias("hot"))
    hot = written(hot, "hot")
    flagged = firsts.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    own = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("anchors"))
    return docs.select("doc_id", "text").join(own, "doc_id").mapInArrow(tidied(run), PIECES)


def sort_batch(doc_ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and start of the strings in these surroundings that also stand earlier in them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    which = np.repeat(np.arange(len(texts)), counts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    group = repeated(text, base[which] + step, length)
    doc, start = doc_ids[which], starts[which] + step
    order = np.lexsort((start, doc, group))
    again = order[1:][group[order[1:]] == group[order[:-1]]]
    return doc[again], start[again]


SORTED = f"hash long, {PIECES}"


def suffix_sorted(rows: DataFrame, length: int, level: int) -> DataFrame:
    """(doc_id, start, n = 1) of strings that repeat an earlier one, and what is left of groups too large to sort.

    Rows are dealt by anchor, and several groups share a sort. A group beyond HEAVY_BYTES of distinct surroundings leaves in
    pieces (bytes) cut by the anchors of the next level, or as hashed strings behind the last one.
    """

    def out(doc: np.ndarray, start: np.ndarray, hashes: np.ndarray | None) -> pa.RecordBatch:
        kept = pa.nulls(len(doc), pa.int64()) if hashes is None else pa.array(hashes.view(np.int64))
        cols = [kept, pa.nulls(len(doc), pa.int64()), pa.array(doc), pa.array(start), pa.array(np.ones(len(doc), np.int32)), pa.nulls(len(doc), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["hash", "key", "doc_id", "start", "n", "bytes"])

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        _, doc, start, n, texts = zip(*rows)
        return out(*sort_batch(np.array(doc), np.array(start), np.array(n), list(texts), length), None)

    def left(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if level < LEVELS:
            batch = _pieces(divided(rows, length, level + 1))
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), *batch.columns], names=["hash", *batch.schema.names])
            return
        for _, doc, start, n, text in rows:
            at = np.arange(n)
            yield out(np.full(n, doc), start + at, Rolling(np.frombuffer(text, np.uint8)).of(at, at + length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        ready_size = size = 0
        group: list[tuple] = []
        last, heavy = None, False
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for row in itertools.chain(flat, [(None, 0, 0, 0, b"")]):
            key = row[0]
            if key != last:
                if heavy:
                    yield from left(group)
                else:
                    ready += group
                    ready_size += size
                if ready and (ready_size > SORT_BYTES or key is None):
                    yield sort(ready)
                    ready, ready_size = [], 0
                group, size, last, heavy = [], 0, key, False
            group.append(row)
            size += len(row[4])
            if size > HEAVY_BYTES or (heavy and len(group) >= 4096):
                heavy = True
                yield from left(group)
                group, size = [], 0

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(run), SORTED)


def duplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, n): the strings of ``length`` bytes at start, ..., start + n - 1 that also stand earlier.

    Earlier means in a smaller doc_id, or in the same document further left. Expects one row for each doc_id.
    """
    found = written(settled(anchored(docs, length)), "anchors")
    again = found.where("again").select("doc_id", "start", "n")
    pieces, light, heavy = surroundings(docs, found.where("not again"), length), None, None
    for level in range(1, LEVELS + 1):
        strings = written(suffix_sorted(pieces, length, level), "sorted")
        some = strings.where("hash is null and key is null").select("doc_id", "start", "n")
        light = some if light is None else light.union(some)
        pieces = strings.where("key is not null").select("key", "doc_id", "start", "n", "bytes")
        if pieces.limit(1).count() == 0:
            break
    heavy = strings.where("hash is not null").select("doc_id", "start", "hash")
    firsts = heavy.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    late = heavy.join(firsts, "hash").where("struct(doc_id, start) > first").selectExpr("doc_id", "start", "1 as n")
    return again.union(light).union(late)


# --- removal -----------------------------------------------------------------------------------------------------------


SPANS = ArrayType(StructType().add("begin", "long").add("end", "long"))


def spans_of(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that the strings cover."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + counts - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    new = np.r_[True, begin[1:] > reach[:-1]]
    return begin[new], np.r_[reach[:-1][new[1:]], reach[-1]]


def without_repeats(docs: DataFrame, length: int = LENGTH, prefix: str = "") -> DataFrame:
    """The documents with their removed runs: all columns, plus kept (the remaining bytes), kept_text (the same as text,
    without the halves of characters at the cuts), n_bytes, n_removed and spans, all named with ``prefix``.

    A byte goes if a string of ``length`` bytes over it also starts earlier (in a smaller doc_id, or further left in the
    same document); strings are judged on the input. Null texts are empty. Rows without doc_id are kept whole; of rows that
    share a doc_id, that with the smallest text counts and the others go. Columns of the new names are replaced.
    """
    tune(docs.sparkSession)
    added = [prefix + c for c in ("kept", "kept_text", "n_bytes", "n_removed", "spans")]
    docs = docs.drop(*added).withColumn("doc_id", F.col("doc_id").cast("long"))
    lone, docs = docs.where("doc_id is null"), one_per_id(docs)
    found = duplicated(docs, length)
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("_strings"))
    rows = docs.join(own, "doc_id", "left").unionByName(lone, allowMissingColumns=True)
    text, strings = rows.columns.index("text"), rows.columns.index("_strings")
    names = [c for c in rows.columns if c != "_strings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_removed, spans = [], [], [], []
            for t, s in zip(batch.column(text).to_pylist(), batch.column(strings)):
                raw, runs = (t or "").encode(), []
                left = raw
                if s.is_valid:
                    starts = s.values.field("start").to_numpy()
                    begin, end = spans_of(starts, s.values.field("n").to_numpy().astype(np.int64), length)
                    runs = list(zip(begin.tolist(), end.tolist()))
                    at = [0, *end.tolist()]
                    left = b"".join(raw[a:b] for a, b in zip(at, [*begin.tolist(), len(raw)]))
                kept.append(left)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                spans.append([{"begin": a, "end": b} for a, b in runs])
            cols = [c for k, c in enumerate(batch.columns) if k != strings]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            cols += [pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    schema = StructType(list(rows.drop("_strings").schema))
    for name, kind in zip(added, ("binary", "string", "long", "long", SPANS)):
        schema = schema.add(name, kind)
    return rows.mapInArrow(tidied(run), schema)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    rows = without_repeats(docs.select("doc_id", "text"), length)
    return rows.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) as n_spans", "sha2(kept, 256) as kept_sha256")


