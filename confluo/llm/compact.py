"""Near-duplicate passages by compact windows.

A text is the sequence of its word shingles. For one hash function, all subsequences whose smallest hash stands at c form
one node of the Cartesian tree over the hashes: they begin in [l, c] and end in [c, r]. Such a compact window (l, c, r)
stands for all of them, and only those of at least the wanted length are kept, about 2 n / length for n shingles. Passages
that are alike share the smallest hash for most hash functions, so windows with equal hashes are joined, their intervals
are laid over each other around c, and pairs of documents that meet under enough functions are verified on the shingles.

Up to FEW windows of one hash are all paired with each other. Of more, those with equal surroundings follow the first of
them, and each first of its surroundings is compared with the BACK firsts before it; as this misses pairs, the places
around such windows are compared once more by what follows them: see ``repeats``. Places of many that no passage found so
connects are compared without a cap: see ``rest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, Rolling, mix, one_per_id, partitions, text_slices, tune, word_spans, written
from .graph import components

SHINGLE = 5
#: Words of the shortest passage, hash functions, and how many of them must agree for a verification.
WORDS = 50
HASHES = 4
AGREE = 2
#: Least Jaccard similarity, in tenths: two passages of n places with m in common have it if 9 m >= 8 n.
TENTHS = 8
CONTEXT = 6

_U = np.uint64
_SEEDS = mix(np.arange(1, 65, dtype=_U) * _U(0xD1B54A32D192ED03))


def shingles_of(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The hashes of each row's word shingles in order; A-Z count as lower case, words end at ASCII white space."""
    lower = LOWER[data]
    starts, ends, counts = word_spans(lower, offsets)
    words = Rolling(lower).of(starts, ends)
    total = np.zeros(len(words), _U)
    for j in range(k):
        total[: len(words) - j] += words[j:] * (_SEEDS[j] | _U(1))
    total, at, out = mix(total), 0, []
    for n in counts.tolist():
        out.append(total[at : at + max(0, n - k + 1)])
        at += n
    return out


def compact_windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), inclusive, of every node of the Cartesian tree that spans at least ``length`` places.

    A zero is a border that no window crosses. Of equal hashes the leftmost is the smallest.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    levels = [hashes]
    while 2 << (len(levels) - 1) <= n:
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    # the smallest place of each stretch of that length: only these can span so much
    size = length.bit_length() - 1
    low = np.minimum(levels[size][: n - length + 1], levels[size][length - (1 << size) : n - (1 << size) + 1])
    stretch = np.flatnonzero(low > 0)
    if not len(stretch):
        return none, none, none
    new = np.r_[True, (low[stretch[1:]] != low[stretch[:-1]]) | (stretch[1:] != stretch[:-1] + 1)]
    c = _first_at(levels, stretch[new], low[stretch[new]])
    c = np.unique(c)
    # equal hashes within one run of stretches: later ones may span enough as well
    same = np.flatnonzero(np.isin(hashes, low[stretch[new]]) & (hashes > 0))
    c = np.union1d(c, same)
    value = hashes[c]
    right, left = c + 1, c.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        ok = right + step <= n
        ok[ok] = level[right[ok]] >= value[ok]
        right[ok] += step
        ok = left - step >= 0
        ok[ok] = level[left[ok] - step] > value[ok]
        left[ok] -= step
    wide = right - left >= length
    return left[wide], c[wide], right[wide] - 1


def _first_at(levels: list[np.ndarray], start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on with a hash of at most ``value``."""
    at = start.copy()
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ok = at + step <= n
        ok[ok] = levels[k][at[ok]] > value[ok]
        at[ok] += step
    return at


#: A window in four numbers: place holds f and the centre, near 32 bits of its surroundings and its reach to either side.
ROWS = "key long, near long, doc_id long, place long"
#: Bits of a place in a text, and the most that is said of a reach; longer passages are covered by several windows.
PLACE, REACH = 28, (1 << 16) - 1


#: Marks rows that hold a finished comparison: f is raised by it, near is the other document, and place has its centre too.
DONE = 64


def _scatter(doc: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(doc.astype(_U) * _U(0x9E3779B97F4A7C15) + c.astype(_U))


def windows(docs: DataFrame, words: int = WORDS, hashes: int = HASHES) -> DataFrame:
    """One row for each compact window of each hash function f of every document.

    Where a slice of texts holds several of equal content from l to r, only the first is dealt by its hash. Those of other
    documents share all of it with the first, so whatever meets one of them is settled by the first; that they do is dealt
    at random, so that a frequent passage does not gather in one task. All other windows are dealt by their hash.
    """
    length = words - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                rows = shingles_of(data, offsets)
                sizes = np.array([len(r) for r in rows], np.int64)
                zero = np.zeros(1, _U)
                flat = np.concatenate([zero, *(x for r in rows for x in (r, zero))])
                base = np.cumsum(sizes + 1) - sizes
                border = np.r_[0, base + sizes]
                roll = Rolling(np.arange(len(flat)), flat)
                for f in range(hashes):
                    h = mix(flat ^ _SEEDS[16 + f]) | _U(1)
                    h[border] = 0
                    l, c, r = compact_windows(h, length)
                    row = np.searchsorted(base, c, side="right") - 1
                    whole = roll.of(l, r + 1)
                    near = mix(flat[np.maximum(c - CONTEXT, l)] ^ mix(flat[np.minimum(c + CONTEXT, r)]))
                    ids = batch.column(0).slice(start, end - start).take(pa.array(row)).to_numpy()
                    l, c, r = (x - base[row] for x in (l, c, r))
                    key = mix(h[c + base[row]] ^ _SEEDS[32 + f])
                    kind, other = np.full(len(c), f), np.zeros(len(c), np.int64)
                    order = np.lexsort((c, ids, c - l, whole, key))
                    same = (key[order[1:]] == key[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]]) & ((c - l)[order[1:]] == (c - l)[order[:-1]])
                    new = np.r_[True, ~same][: len(order)]
                    later, first = order[~new], order[np.flatnonzero(new)[np.cumsum(new) - 1]][~new]
                    later, first = later[ids[later] != ids[first]], first[ids[later] != ids[first]]
                    before, after = (c - l)[later], (r - c)[later]
                    key[later] = (before.astype(_U) << _U(32) | after.astype(_U)) ^ _scatter(ids[later], c[later])
                    reach = np.minimum(c - l, REACH) << 16 | np.minimum(r - c, REACH)
                    near = (near >> _U(32) << _U(32) | reach.astype(_U)).view(np.int64).copy()
                    near[later], kind[later], other[later] = ids[first], f + DONE, c[first]
                    place = kind.astype(np.int64) << 2 * PLACE | other << PLACE | c
                    cols = [pa.array(x) for x in (key.view(np.int64), near, ids, place)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "near", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


#: So many windows of one hash, or stretches of one content, are all paired with each other.
FEW = 16
#: Of more windows, a first of its surroundings is compared with so many firsts before it.
BACK = 4
#: f is SURE for pairs that need no second hash function; HOT marks the places cs to cd of src, around a window of many.
SURE, HOT = -1, 64
MET = "src long, dst long, f int, cs int, cd int, before int, after int"


def _met(*cols: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(cols, kinds)], names=["src", "dst", "f", "cs", "cd", "before", "after"])


def _laid(source: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, near: np.ndarray, least: int) -> pa.RecordBatch:
    f, _, c = _placed(place)
    before, after = (np.minimum(x[at], x[source]) for x in (near >> 16 & REACH, near & REACH))
    ok = (doc[at] != doc[source]) & (before + after + 1 >= least)
    source, at = source[ok], at[ok]
    swap = doc[source] > doc[at]
    source, at = np.where(swap, at, source), np.where(swap, source, at)
    return _met(doc[source], doc[at], f[at], c[source], c[at], before[ok], after[ok])


def _placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """f, the centre in the other document of a finished comparison, and the own centre."""
    return place >> 2 * PLACE, place >> PLACE & (1 << PLACE) - 1, place & (1 << PLACE) - 1


def _after(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]


def _all_pairs(key: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of equal keys less than FEW rows apart; the second is not among the first ``old`` rows."""
    pairs = []
    for back in range(1, FEW):
        at = np.arange(max(old, back), len(key))
        at = at[key[at] == key[at - back]]
        if not len(at):
            break
        pairs.append((at - back, at))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2


def _counted(rows: DataFrame, *order: str) -> DataFrame:
    """The rows dealt by key and sorted, with the number of rows of the key as n."""
    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", *order)
    return dealt.withColumn("n", F.count("*").over(W.partitionBy("key")))


def joined(rows: DataFrame, length: int) -> DataFrame:
    """Windows of equal hash laid over each other: centres, and how many places before and after both have.

    Those of hashes that more than FEW windows have are given as HOT too. The rows pass by as a stream sorted by hash and
    surroundings; memory holds a batch and a few rows.
    """
    least = length * TENTHS // 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few: pa.RecordBatch | None = None  # the last windows of small groups
        held: pa.RecordBatch | None = None  # the last firsts
        for batch in batches:
            f, n = _placed(batch.column(3).to_numpy())[0], batch.column(4).to_numpy()
            done = f >= DONE
            if done.any():
                key, src, dst, place, _ = (x.to_numpy()[done] for x in batch.columns)
                _, cs, cd = _placed(place)
                both = key.view(_U) ^ _scatter(dst, cd)
                swap = src > dst
                yield _met(np.where(swap, dst, src), np.where(swap, src, dst), np.full(len(src), SURE), np.where(swap, cd, cs), np.where(swap, cs, cd), (both >> _U(32)).astype(np.int32), both.astype(np.uint32).astype(np.int32))
            small = batch.take(pa.array(np.flatnonzero(~done & (n <= FEW))))
            if small.num_rows:
                now = _after(few, small)
                key, near, doc, place, _ = (x.to_numpy() for x in now.columns)
                yield _laid(*_all_pairs(key, now.num_rows - small.num_rows), doc, place, near, least)
                few = now.slice(max(0, now.num_rows - FEW + 1))
            batch = batch.take(pa.array(np.flatnonzero(~done & (n > FEW))))
            if not batch.num_rows:
                continue
            _, near, doc, place, _ = (x.to_numpy() for x in batch.columns)
            none, c = np.zeros(len(doc), np.int32), _placed(place)[2]
            yield _met(doc, doc, none + HOT, c - np.minimum(near >> 16 & REACH, length - 1), c + np.minimum(near & REACH, length - 1), none, none)
            now = _after(held, batch)
            key, near, doc, place, _ = (x.to_numpy() for x in now.columns)
            around = near >> 32
            new = np.r_[True, (key[1:] != key[:-1]) | (around[1:] != around[:-1])]
            heads = np.flatnonzero(new)
            fresh = np.arange(len(key)) >= (0 if held is None else held.num_rows)
            follow = np.flatnonzero(~new & fresh)
            pairs = [(heads[np.cumsum(new) - 1][follow], follow)]
            for back in range(1, BACK + 1):
                a, b = heads[:-back], heads[back:]
                ok = (key[a] == key[b]) & fresh[b]
                pairs.append((a[ok], b[ok]))
            yield _laid(*(np.concatenate(x) for x in zip(*pairs)), doc, place, near, least)
            held = now.take(pa.array(heads[-BACK:]))

    return _counted(rows, "near", "doc_id", "place").where(f"n > 1 or shiftright(place, {2 * PLACE}) >= {DONE}").mapInArrow(run, MET)


def _two(high: str, low: str) -> "F.Column":
    """Two non-negative integers in one."""
    return F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(F.col(low))


def _one(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return both >> 32, both & 0xFFFFFFFF


AROUND = "key long, component long, whole long, doc_id long, at int, as_src int, as_dst int, shingles array<long>"


def _least_kinds(own: np.ndarray, at: np.ndarray, run: int, n: int) -> np.ndarray:
    """The least number of different shingles in n places in a row that hold the ``run`` places from each of ``at`` on; 0 where there are none."""
    least = np.zeros(len(at), np.int64)
    if len(own) < n:
        return least
    order = np.argsort(own, kind="stable")
    before, again = order[:-1], order[1:]
    near = (own[before] == own[again]) & (again - before < n)
    change = np.zeros(len(own) + 1, np.int64)  # stretches from again - n + 1 to before have one place that counts no more
    np.add.at(change, np.maximum(again[near] - n + 1, 0), -1)
    np.add.at(change, before[near] + 1, 1)
    levels = [n + np.cumsum(change)[: len(own) - n + 1]]
    while 2 << (len(levels) - 1) <= n:
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1], np.r_[levels[-1][step:], levels[-1][-1:].repeat(min(step, len(levels[-1])))][: len(levels[-1])]))
    first, last = np.maximum(at + run - n, 0), np.minimum(at, len(own) - n)
    for k, level in enumerate(levels):
        some = (last - first + 1) >> k == 1
        least[some] = np.minimum(level[first[some]], level[last[some] - (1 << k) + 1])
    return least


def rest(docs: DataFrame, many: DataFrame, labels: DataFrame, length: int) -> DataFrame:
    """All pairs of places of one run of ``many`` (doc_id, key, at) that are not of one class (id, component) and may be alike.

    Nothing is capped. A passage with the run in it has at least ``length`` places, and its counterpart TENTHS of that; each has
    at least TENTHS of its different shingles in common with the other, and so of the fewest that so many places around the
    run hold (``_least_kinds``). Of two sets with that much in common each has one of the common shingles among
    those left when all but one of that many are taken away from the end of a fixed order. The order goes by how many places
    around that run have a shingle, so what all have around it is taken away, and pairs arise by what few have. Of places of
    one class with equal surroundings the first stands for them.
    """
    run_length = _run_length(length)
    sizes = (length, length * TENTHS // 10)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                rows, known = [], {}
                for k, own in enumerate(shingles_of(data, offsets), start):
                    doc, component = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                    places = batch.column(3)[k].values
                    keys, at = (places.field(x).to_numpy() for x in ("key", "at"))
                    least = [_least_kinds(own, at.astype(np.int64), run_length, n).tolist() for n in sizes]
                    for key, x, *kinds in zip(keys.tolist(), at.tolist(), *least):
                        first = min(x, length - 1)
                        near = own[x - first : x + run_length + length - 1]
                        whole = int.from_bytes(hashlib.blake2b(near.tobytes() + first.to_bytes(4), digest_size=8).digest(), "little", signed=True)
                        if whole not in known:
                            some = _sorted_set(near)
                            known[whole] = some.view(np.int64), *(len(some) - -(-n * TENTHS // 10) + 1 if n else 0 for n in kinds)
                        some, as_src, as_dst = known[whole]
                        rows.append((key, component, whole, doc, x, as_src, as_dst, some))
                cols = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "component", "whole", "doc_id", "at", "as_src", "as_dst", "shingles"])

    many = many.join(labels.selectExpr("id as doc_id", "component"), "doc_id", "left").selectExpr("doc_id", "key", "at", "coalesce(component, doc_id) as component")
    apart = many.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    places = many.join(apart, "key").groupBy("doc_id", "component").agg(F.collect_set(F.struct("key", "at")).alias("places"))
    found = docs.select("doc_id", "text").join(places, "doc_id").select("doc_id", "text", "component", "places").mapInArrow(around, AROUND)
    firsts = found.groupBy("key", "component", "whole").agg(F.min(F.struct("doc_id", "at", "as_src", "as_dst", "shingles")).alias("r")).select("key", "component", "r.*")
    each = firsts.withColumn("shingle", F.explode("shingles")).drop("shingles")
    alike = W.partitionBy("key", "shingle")
    each = each.withColumns({"n": F.count("*").over(alike), "apart": F.min("component").over(alike) != F.max("component").over(alike)})
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("key", "doc_id", "at").orderBy("n", "shingle")))
    each = each.where("apart and rank <= greatest(as_src, as_dst)").selectExpr("key", "shingle", "component", "doc_id", "at", "rank <= as_src as as_src", "rank <= as_dst as as_dst")
    each = written(each, "rest", drop_shuffles=True).repartition(partitions(docs.sparkSession), "key", "shingle")
    # documents meet with all their places at once, as a line that a document repeats has many there
    places = {x: F.collect_list(F.when(F.col(f"as_{x}"), F.col("at"))).alias(f"as_{x}") for x in ("src", "dst")}
    each = each.groupBy("key", "shingle", "component", "doc_id").agg(*places.values())
    each = each.withColumn("apart", F.min("component").over(alike) != F.max("component").over(alike)).where("apart")
    a, b = (each.where(f"size(as_{x}) > 0").selectExpr("key", "shingle", f"component as {x}_class", f"doc_id as {x}", f"as_{x}") for x in ("src", "dst"))
    met = a.join(b, ["key", "shingle"]).where("src < dst and src_class <> dst_class")
    pairs = met.select("src", "dst", F.explode("as_src").alias("cs"), "as_dst").select("src", "dst", "cs", F.explode("as_dst").alias("cd")).distinct()
    return pairs.selectExpr("src", "dst", f"{SURE} as f", "cs", "cd", f"least({length}, cs, cd) as before", f"{run_length + length} as after")


STRETCHES = "key long, whole long, doc_id long, at int"
#: Of so many neighbouring places, that with the smallest hash gives a stretch.
NEIGHBOURS = 4


def lowest_places(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Marks the places that have the smallest hash, the last of equal ones, among some NEIGHBOURS places of one row in a row."""
    n, chosen = len(h), np.zeros(len(h), bool)
    if n < NEIGHBOURS:
        return chosen
    at = np.arange(n - NEIGHBOURS + 1)
    best = at.copy()
    for k in range(1, NEIGHBOURS):
        best = np.where(h[at + k] <= h[best], at + k, best)
    chosen[best[row[: len(at)] == row[NEIGHBOURS - 1 :]]] = True
    return chosen


def _run_length(length: int) -> int:
    return max(1, -(-8 * length // 9) // 2 - NEIGHBOURS + 1)


def repeats(docs: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Pairs around windows of hashes that many have, by equal stretches instead of equal minima.

    Of every NEIGHBOURS places there the one with the smallest hash gives the content of its ``run`` places from it on, and of
    as many as a shortest passage has from there on at least. Two passages of the wanted similarity with one gap have an
    unbroken stretch of a run and NEIGHBOURS - 1 places more in common, and hence a run that both give. Up to FEW places of
    one run are all paired. Of more, those with the same whole content follow the first of them. The firsts are compared with the BACK firsts before them, in the order of their hashes;
    as a passage has many runs, each of them in another order, what is alike is found with a high probability. Places of a
    run that more than FEW have are given as HOT too, with the run as dst; ``rest`` compares those that this leaves apart.
    """
    run_length = _run_length(length)
    whole_length = max(run_length, length - NEIGHBOURS + 1)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                rows = shingles_of(data, offsets)
                sizes = np.array([len(x) for x in rows], np.int64)
                stop = np.cumsum(sizes)
                flat = np.concatenate([np.zeros(0, _U), *rows])
                count = np.zeros(len(flat) + 1, np.int64)
                for base, own in zip((stop - sizes).tolist(), batch.column(2).slice(start, end - start)):
                    first, last = _one(own.values.to_numpy())
                    np.add.at(count, base + first, 1)
                    np.add.at(count, base + last + 1, -1)
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.flatnonzero((np.cumsum(count[:-1]) > 0) & lowest_places(mix(flat), row))
                at = at[at + run_length <= stop[row[at]]]
                roll = Rolling(np.arange(len(flat)), flat)
                full = at + whole_length <= stop[row[at]]
                whole = np.zeros(len(at), _U)
                whole[full] = roll.of(at[full], at[full] + whole_length) | _U(1)
                ids = batch.column(0).slice(start, end - start).take(pa.array(row[at]))
                cols = [pa.array(roll.of(at, at + run_length).view(np.int64)), pa.array(whole.view(np.int64)), ids, pa.array((at - (stop - sizes)[row[at]]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "whole", "doc_id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few: pa.RecordBatch | None = None
        held: pa.RecordBatch | None = None
        for batch in batches:
            n = batch.column(4).to_numpy()
            small = batch.take(pa.array(np.flatnonzero(n <= FEW)))
            if small.num_rows:
                now = _after(few, small)
                key, _, doc, at, _ = (x.to_numpy() for x in now.columns)
                a, b = _all_pairs(key, now.num_rows - small.num_rows)
                swap = doc[a] > doc[b]
                a, b = np.where(swap, b, a)[doc[a] != doc[b]], np.where(swap, a, b)[doc[a] != doc[b]]
                before = np.minimum(length, np.minimum(at[a], at[b]))
                yield _met(doc[a], doc[b], np.full(len(a), SURE), at[a], at[b], before, np.full(len(a), run_length + length))
                few = now.slice(max(0, now.num_rows - FEW + 1))
            many = batch.take(pa.array(np.flatnonzero(n > FEW)))
            if many.num_rows:
                key, _, doc, at, _ = (x.to_numpy() for x in many.columns)
                none = np.zeros(len(doc), np.int32)
                yield _met(doc, key, none + HOT, at, at, none, none)
            batch = batch.take(pa.array(np.flatnonzero((n > FEW) & (batch.column(1).to_numpy() != 0))))
            if not batch.num_rows:
                continue
            now = _after(held, batch)
            key, whole, doc, at, _ = (x.to_numpy() for x in now.columns)
            new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
            heads = np.flatnonzero(new)
            first = heads[np.cumsum(new) - 1]
            old = 0 if held is None else held.num_rows
            b = np.flatnonzero(~new & (doc != doc[first]) & (np.arange(len(key)) >= old))
            a = first[b]
            swap = doc[a] > doc[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield _met(doc[a], doc[b], np.full(len(a), SURE), at[a], at[b], np.minimum(length, np.minimum(at[a], at[b])), np.full(len(a), run_length + length))
            # the firsts of one run with each other, while they are few places apart
            pairs = [(x[ok], y[ok]) for back in range(1, BACK + 1) for x, y in [(heads[:-back], heads[back:])] for ok in [(key[x] == key[y]) & (doc[x] != doc[y]) & (y >= old)]]
            a, b = (np.concatenate(x) for x in zip(*pairs))
            some = np.unique(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])]), axis=1, return_index=True)[1] if len(a) else np.zeros(0, np.int64)
            a, b = a[some], b[some]
            swap = doc[a] > doc[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            before = np.minimum(length, np.minimum(at[a], at[b]))
            yield _met(doc[a], doc[b], np.full(len(a), SURE), at[a], at[b], before, np.full(len(a), run_length + length))
            held = now.take(pa.array(heads[-BACK:]))

    regions = hot.groupBy(F.col("src").alias("doc_id")).agg(F.collect_list(_two("cs", "cd")).alias("places"))
    rows = docs.select("doc_id", "text").join(regions, "doc_id").select("doc_id", "text", "places").mapInArrow(stretches, STRETCHES)
    return _counted(rows, "whole", "doc_id", "at").where("n > 1").mapInArrow(run, MET)


SEGMENTS = "src long, dst long, part int, s_lo int, s_hi int, d_lo int, d_hi int"
#: Diagonals that differ by no more than this are one alignment.
DRIFT = 24


def merged(cs: np.ndarray, cd: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Overlapping intervals on close diagonals as (first, last) places in both documents."""
    order = np.lexsort((cs - before, cd - cs))
    out: list[list[int]] = []
    for i in order.tolist():
        a, b, shift = int(cs[i] - before[i]), int(cs[i] + after[i]), int(cd[i] - cs[i])
        for box in reversed(out):
            if shift - box[2] > DRIFT:
                break
            if a <= box[1] + 1 and b + 1 >= box[0]:
                box[0], box[1], box[3] = min(a, box[0]), max(b, box[1]), max(shift, box[3])
                break
        else:
            out.append([a, b, shift, shift])
    return [(a, b, max(0, a + low), b + high) for a, b, low, high in out]


def segments(met: DataFrame, agree: int = AGREE) -> DataFrame:
    """The stretches to verify of the pairs of documents that meet under at least ``agree`` hash functions, or surely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                src, dst, own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                found = merged(*_one(own.field("centres").to_numpy()), *_one(own.field("reach").to_numpy()))
                rows += [(src, dst, part, *box) for part, box in enumerate(found)]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["src", "dst", "part", "s_lo", "s_hi", "d_lo", "d_hi"])

    pairs = met.groupBy("src", "dst").agg(F.when(F.min("f") == SURE, agree).otherwise(F.count_distinct("f")).alias("agree"), F.collect_list(F.struct(_two("cs", "cd").alias("centres"), _two("before", "after").alias("reach"))).alias("at"))
    return pairs.where(F.col("agree") >= agree).select("src", "dst", "at").mapInArrow(run, SEGMENTS)


def shingles_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, dst, part, side, lo, shingles): the wanted stretches of the documents, 32 bits for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(0)):
                rows = []
                for k, own in enumerate(shingles_of(data, offsets), start):
                    low = (own >> _U(32)).astype(np.uint32)
                    for w in batch.column(1)[k].as_py():
                        rows.append((w["src"], w["dst"], w["part"], w["side"], w["lo"], low[w["lo"] : w["hi"] + 1].tobytes()))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["src", "dst", "part", "side", "lo", "shingles"])

    both = wanted.selectExpr("src as doc_id", "src", "dst", "part", "0 as side", "s_lo as lo", "s_hi as hi").union(wanted.selectExpr("dst as doc_id", "src", "dst", "part", "1 as side", "d_lo as lo", "d_hi as hi"))
    own = both.groupBy("doc_id").agg(F.collect_list(F.struct("src", "dst", "part", "side", "lo", "hi")).alias("wanted"))
    schema = "src long, dst long, part int, side int, lo int, shingles binary"
    return docs.select("doc_id", "text").join(own, "doc_id").select("text", "wanted").mapInArrow(run, schema)


#: What a place without a counterpart costs against one with, from the similarity wanted to unbroken runs.
COSTS = (TENTHS, 3 * TENTHS, 1 << 20)


def alike(a: np.ndarray, b: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Passages (begin and end in a, begin and end in b; ends exclusive) of that similarity, none inside another.

    The longest stretch of a that is dense enough in places of b is taken, and compared with where these lie in b. If that
    falls short, denser stretches within it are looked at, down to unbroken runs; else what is left and right of it.
    """
    if len(a) >= length and np.array_equal(a, b):
        return [(0, len(a), 0, len(b))]
    out, todo = [], [(0, len(a), 0)]
    known = _held(a, np.sort(b))
    if (1 + TENTHS) * np.count_nonzero(known) < TENTHS * length:
        return []
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo < length:
            continue
        total = np.zeros(hi - lo + 1, np.int64)
        np.cumsum(np.where(known[lo:hi], 1, -COSTS[level]), out=total[1:])
        best = np.maximum.accumulate(total[::-1])[::-1]  # largest sum from each place on
        far = len(best) - best[::-1].searchsorted(total) - 1
        i = int((far - np.arange(len(total))).argmax())
        j = int(far[i])
        if j - i < length:
            if level + 1 < len(COSTS) and np.count_nonzero(known[lo:hi]) >= length:
                todo.append((lo, hi, level + 1))
            continue
        mine = a[lo + i : lo + j]
        found = _counterpart(mine, b, length)
        if found:
            out.append((lo + i, lo + j, *found))
        elif level + 1 < len(COSTS):
            todo.append((lo + i, lo + j, level + 1))
        todo += [(lo, lo + i, level), (lo + j, hi, level)]
    return out


def _counterpart(mine: np.ndarray, b: np.ndarray, length: int) -> tuple[int, int] | None:
    """Begin and end of a stretch of b that is similar enough: a literal copy, or where the middle one of the places lies."""
    n, whole, wanted = len(mine), b.tobytes(), mine.tobytes()
    x = whole.find(wanted)
    while x % b.itemsize and x > 0:  # not at the border of a place
        x = whole.find(wanted, x + 1)
    if x >= 0:
        return x // b.itemsize, x // b.itemsize + n
    one = _sorted_set(mine)
    places = np.flatnonzero(_held(b, one))
    if not len(places):
        return None
    middle = int(places[len(places) // 2])
    places = places[np.abs(places - middle) <= n // 2 + DRIFT]
    x, y = int(places[0]), int(places[-1]) + 1
    two = _sorted_set(b[x:y])
    both = np.count_nonzero(_held(one, two))
    if 10 * both >= TENTHS * (len(one) + len(two) - both) and y - x >= length * TENTHS // 10:
        return x, y
    return None


def _held(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values.take(values.searchsorted(x), mode="clip") == x


def _sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


PASSAGES = "src long, dst long, s_begin int, s_end int, d_begin int, d_end int"


def passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Verified pairs of passages: src, dst and word places (ends exclusive) in both. Expects one row for each doc_id."""
    length = words - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, dst, s_lo, d_lo, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                for i, j, x, y in alike(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), length):
                    rows.append((src, dst, s_lo + i, s_lo + j + SHINGLE - 1, d_lo + x, d_lo + y + SHINGLE - 1))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["src", "dst", "s_begin", "s_end", "d_begin", "d_end"])

    def verified(pairs: DataFrame) -> DataFrame:
        found = shingles_in(docs, written(segments(pairs), "segments", drop_shuffles=True))
        pairs = found.groupBy("src", "dst", "part").agg(
            F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("s_lo"), F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("d_lo"),
            F.max(F.when(F.col("side") == 0, F.col("shingles"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("shingles"))).alias("b"),
        )
        found = pairs.select("src", "dst", "s_lo", "d_lo", "a", "b").where("a is not null and b is not null").mapInArrow(run, PASSAGES)
        return written(found, "passages", drop_shuffles=True)

    met = written(joined(windows(docs, words), length), "met", drop_shuffles=True)
    again = written(repeats(docs, met.where(F.col("f") == HOT), length), "repeats", drop_shuffles=True)
    found = verified(met.where(F.col("f") < HOT).union(again.where(F.col("f") < HOT)))
    many = again.where(F.col("f") == HOT).selectExpr("src as doc_id", "dst as key", "cs as at")
    labels = components(found.select("src", "dst").distinct())
    left = written(rest(docs, many, labels, length), "left", drop_shuffles=True)
    return found if left.isEmpty() else found.union(verified(left))


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_passages, n_words and passages of every document.

    Documents that share a near-duplicate passage of at least ``words`` words (5-word shingles, similarity of 0.8 or more)
    are of one class, whose id is its smallest doc_id; a document without one is a class of its own. passages are the
    merged runs of words (begin, end exclusive) that another document has too, n_words their sum. Null and short texts have
    none. Of rows that share a doc_id the one with the smallest text counts; rows without doc_id are classes of their own
    with a null id. Other columns are ignored.
    """
    tune(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    lone, docs = docs.where("doc_id is null"), one_per_id(docs)
    found = passages(docs, words)
    labels = components(found.select("src", "dst").distinct()).withColumnRenamed("id", "doc_id")
    ends = found.selectExpr("src as doc_id", "s_begin as begin", "s_end as end").union(found.selectExpr("dst as doc_id", "d_begin as begin", "d_end as end"))
    runs = ends.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("r"))
    merge = """aggregate(r, cast(array() as array<struct<begin: int, end: int>>), (done, x) ->
        if(size(done) > 0 and x.begin <= element_at(done, -1).end,
           concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, x.end)))),
           concat(done, array(x))))"""
    rows = docs.select("doc_id").join(labels, "doc_id", "left").join(runs.selectExpr("doc_id", f"{merge} as passages"), "doc_id", "left")
    rows = rows.union(lone.selectExpr("doc_id", "cast(null as long) as component", "cast(null as array<struct<begin: int, end: int>>) as passages"))
    rows = rows.selectExpr("doc_id", "coalesce(component, doc_id) as class_id", "coalesce(passages, cast(array() as array<struct<begin: int, end: int>>)) as passages")
    return rows.selectExpr("doc_id", "class_id", "cast(size(passages) as long) as n_passages", "aggregate(passages, 0L, (n, p) -> n + p.end - p.begin) as n_words", "passages")
