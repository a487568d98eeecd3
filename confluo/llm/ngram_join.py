"""Size-aware heavy-light self-join of documents on the Jaccard similarity of their word n-grams, exact at a threshold.

Small (light) sets: every pair of sizes (n, m) fixes the least overlap c that reaches the threshold, and sets of these
sizes have it exactly if they share a subset of c elements. All such subsets are enumerated and become join keys.

Large (heavy) sets: inverted lists are scanned. A list belongs to a block of the hashed n-gram universe with its content,
not to a single n-gram, so that a frequent passage does not make a long list. Sets of one size class may differ in at most
H elements; with H + 1 + E blocks at least 1 + E blocks are alike in both, so a qualifying pair always meets in a list.

The boundary is chosen by cost: the sizes of all sets are counted, the lists that the small ones would make are measured,
and the boundary is the size that writes and scans the fewest rows (``cheapest_boundary``).

Equal sets are found first, by a digest, and only one of them takes part in the join. Lists are not expanded into pairs.
Round one compares every document with a centre of its lists, round two with the centres of all lists that are not yet
connected. What is left are members of lists of three and more that are neither connected nor alike to a centre; of these
only pairs are compared that odd sketches allow. A sketch has at least eight bits for each element in which two sets that
qualify may differ, so it counts differences almost exactly and hardly lets through more than the links themselves; as it
never overstates them, no link between components is lost. The result is the partition that all qualifying links give.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, one_per_id, partitions, repeats_ids, Rolling, text_slices, tidied, tune, word_spans, written
from .graph import components

_U = np.uint64
_ODD = mix(np.arange(101, 165, dtype=_U)) | _U(1)
#: Rows of ids (and a digest) are broadcast up to this number, and shuffled beyond it.
BROADCAST_IDS = 500_000
#: The largest boundary that is weighed: the number of subsets grows faster than any power of the size.
MOST_LIGHT = 24
#: 64-bit words of an odd sketch: for sets that may differ in up to 128 elements, and SKETCH_BITS for each element beyond.
SKETCH_WORDS = 16
SKETCH_BITS = 8


# --- sets of n-grams -------------------------------------------------------------------------------------------------


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each row's k-word n-grams; fewer words than k count as one n-gram."""
    lower = LOWER[data]
    starts, ends, counts = word_spans(lower, offsets)
    words = Rolling(lower).of(starts, ends)
    total = np.zeros(len(words), _U)
    for j in range(k):
        total[: len(words) - j] += words[j:] * _ODD[j]
    grams = mix(total)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            out.append(mix((words[at : at + n] * _ODD[:n]).sum(keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


# --- sizes -----------------------------------------------------------------------------------------------------------


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest i with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def largest_partner(n: int, percent: int) -> int:
    return 100 * n // percent


class Plan:
    """Which keys a set of each size gets, for a threshold in percent."""

    def __init__(self, percent: int, light: int = 0):
        """Sets of up to ``light`` n-grams are enumerated, larger ones go to lists."""
        self.percent = percent
        self.light = light
        self.bounds = [self.light + 1]

    def size_pairs(self, n: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, overlap) of the pairs of sizes that a set of n elements can be part of."""
        p = self.percent
        up = [(n, m) for m in range(n, largest_partner(n, p) + 1)]
        down = [(m, n) for m in range(1, n) if largest_partner(m, p) >= n]
        return [(a, b, least_overlap(a, b, p)) for a, b in up + down]

    def light_keys(self, n: int) -> int:
        return sum(math.comb(n, c) for _, _, c in self.size_pairs(n))

    def may_differ(self, n: int) -> int:
        """In how many elements a set of n and another may differ at the threshold."""
        return (100 - self.percent) * (n + largest_partner(n, self.percent)) // (100 + self.percent)

    def class_of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(largest_partner(self.bounds[-1], self.percent) + 1)
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    @functools.lru_cache(maxsize=None)
    def blocks(self, cls: int) -> tuple[int, int]:
        """Blocks of a size class, and how many of them may be empty in a set that leaves empty blocks out."""
        while len(self.bounds) < cls + 2:
            self.bounds.append(largest_partner(self.bounds[-1], self.percent) + 1)
        most = self.bounds[cls + 1] - 1
        differ = self.may_differ(most)
        spare = 1 + differ // 32
        return differ + 1 + spare, spare

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The join keys of one set (sorted distinct hashes)."""
        n, out = len(grams), []
        if not n:
            return grams
        scattered = mix(grams ^ _U(0x5851F42D4C957F2D))
        for a, b, c in self.size_pairs(n) if n <= largest_partner(self.light, self.percent) else []:
            if a <= self.light:
                tag = mix(np.array([a << 20 | b], _U))
                sums = [sum(int(x) for x in s) & 0xFFFFFFFFFFFFFFFF for s in itertools.combinations(scattered, c)]
                out.append(mix(np.array(sums, _U) ^ tag))
        if n > self.light:
            own = self.class_of(n)
            out.append(self._block_keys(grams, scattered, own))
            if own:  # as the larger partner of a set of the class below
                out.append(self._block_keys(grams, scattered, own - 1))
        return np.concatenate(out)

    def _block_keys(self, grams: np.ndarray, scattered: np.ndarray, cls: int) -> np.ndarray:
        blocks, spare = self.blocks(cls)
        block = ((grams >> _U(32)) * _U(blocks)) >> _U(32)
        cuts = np.searchsorted(block, np.arange(blocks + 1, dtype=_U))
        sums = np.zeros(len(grams) + 1, _U)
        np.cumsum(scattered, out=sums[1:])
        ids = np.arange(blocks, dtype=_U) + _U(cls << 32)
        keys = mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ mix(ids))
        empty = cuts[1:] == cuts[:-1]
        return keys[~empty] if empty.sum() <= spare else keys


# --- passes over the documents -----------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text")


def sizes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, whole, grams) of every row: size and digest of its set, and the set itself up to MOST_LIGHT n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                sets = gram_sets(data, offsets, k)
                n = pa.array([len(g) for g in sets], pa.int64())
                whole = pa.array([hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets], pa.binary())
                small = pa.array([g.tobytes() if len(g) <= MOST_LIGHT else None for g in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), n, whole, small], names=["doc_id", "n", "whole", "grams"])

    return _texts(docs).mapInArrow(tidied(run), "doc_id long, n long, whole binary, grams binary")


def cheapest_boundary(sized: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets costs fewest rows, by the sets there are.

    An enumerated set costs its keys. A listed one costs its keys and the members of its lists that a scan would meet; the
    lists of all sets of up to MOST_LIGHT n-grams are made for that and measured. At most MOST_LIGHT counts reach the driver.
    """
    plan = Plan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [plan.keys(np.frombuffer(g, _U)) for g in batch.column(1).to_pylist()]
            n = np.repeat(batch.column(0).to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, _U), *keys]).view(np.int64)), pa.array(n)], names=["key", "n"])

    small = sized.where("n > 0 and grams is not null")
    rows = small.select("n", "grams").mapInArrow(tidied(run), "key long, n long").groupBy("key", "n").agg(F.count("*").alias("own"))
    lists = rows.groupBy("key").agg(F.sum("own").alias("size"))
    scans = dict(rows.join(lists, "key").groupBy("n").agg(F.sum(F.col("own") * F.col("size"))).collect())
    counts = dict(small.groupBy("n").count().collect())
    listed = {n: counts.get(n, 0) * len(plan.keys(mix(np.arange(n, dtype=_U)))) + scans.get(n, 0) for n in range(1, MOST_LIGHT + 1)}
    cost = [sum(counts.get(n, 0) * plan.light_keys(n) if n <= x else listed[n] for n in listed) for x in range(MOST_LIGHT + 1)]
    return int(np.argmin(cost))


def keyed(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """(key, doc_id, n): one row per join key of each document; a document with an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                sets = gram_sets(data, offsets, k)
                keys = [plan.keys(g) for g in sets]
                many = [len(x) for x in keys]
                at = pa.array(start + np.repeat(np.arange(len(sets)), many))
                n = np.repeat(np.array([len(g) for g in sets], np.int32), many)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), ids.take(at), pa.array(n)], names=["key", "doc_id", "n"])

    return _texts(docs).mapInArrow(tidied(run), "key long, doc_id long, n int")


def lists(rows: DataFrame) -> DataFrame:
    """(key, doc_id, n): members of lists of two and more.

    The rows are dealt and sorted by key and pass by as a stream, so a long list needs no memory; a group of near copies
    shares many keys, which spread over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last row, while it is not known whether it stays alone
        last = None  # the key of the last row given out
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = now.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            many = np.r_[False, same] | np.r_[same, False]
            if last is not None and keys[0] == last:
                many[0] = True
            rest = None if many[-1] else now.slice(len(keys) - 1)
            found = np.flatnonzero(many)
            if len(found):
                last = keys[found[-1]]
                yield now.take(pa.array(found))

    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(tidied(run), "key long, doc_id long, n int")


def sketch_words(differ: int) -> int:
    """64-bit words of the sketch of a set that may differ from another in so many elements; a power of two."""
    words = SKETCH_WORDS
    while words * 64 < SKETCH_BITS * differ:
        words *= 2
    return words


def odd_sketch(grams: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bits that are each the parity of how many elements hash to it: sketches differ in at most as many bits as sets in elements.

    Halves laid over each other by exclusive or give the sketch of half as many words.
    """
    place = (mix(grams ^ _U(0x3C79AC492BA7B653)) & _U(64 * words - 1)).astype(np.int64)
    ones = np.bincount(place, minlength=64 * words) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.int64)


def sketches(sets: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, odd): the odd sketch of every set, as long as its size asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(g, _U) for g in batch.column(1).to_pylist()]
            odd = [odd_sketch(g, sketch_words(plan.may_differ(len(g)))) for g in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "odd"])

    return sets.select("doc_id", "grams").mapInArrow(tidied(run), "doc_id long, odd array<long>")


def differing_sql(a: str, b: str) -> str:
    """SQL for the number of bits in which two odd sketches differ; the longer one is folded to the length of the other."""
    short = " + ".join(f"bit_count({a}[{j}] ^ {b}[{j}])" for j in range(SKETCH_WORDS))

    def bits(x: str, n: str) -> str:
        return f"if(size({x}) = {n}, {x}[i], {x}[i] ^ {x}[i + {n}])"

    n = f"least(size({a}), size({b}))"
    long = f"aggregate(sequence(0, {n} - 1), 0, (s, i) -> s + bit_count(({bits(a, n)}) ^ ({bits(b, n)})))"
    return f"case when size({a}) = {SKETCH_WORDS} and size({b}) = {SKETCH_WORDS} then {short} else {long} end"


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, grams) of the documents in ``ids``: the set as sorted unsigned 64-bit integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                found = pa.array([g.tobytes() for g in gram_sets(data, offsets, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), found], names=["doc_id", "grams"])

    return _texts(docs).join(_small(ids), "doc_id", "left_semi").mapInArrow(tidied(run), "doc_id long, grams binary")


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["src", "dst"])

    left = sets.selectExpr("doc_id as src", "grams as a")
    right = sets.selectExpr("doc_id as dst", "grams as b")
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(tidied(run), "src long, dst long")


def linked(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest doc_id that links reach) of every document.

    Documents link when 100 * intersection >= percent * union of their sets of k-word n-grams, over text with A-Z in lower
    case. A null or empty text, or one of white space, has an empty set and links with nothing; fewer words than k are one
    n-gram. Of rows that share a doc_id the one with the smallest text links for all; every row is given, with its own size
    and that component. A null doc_id gives a row with a null component. Other columns are ignored; an empty table gives no
    rows. n-grams are compared as 64-bit hashes, whole sets as 128-bit digests of these.
    """
    tune(docs.sparkSession)
    docs = _texts(docs)
    sized = written(sizes(docs, k), "sizes")
    several = repeats_ids(docs)
    one = one_per_id(docs) if several else docs.where("doc_id is not null")
    nodes = written(sizes(one, k), "nodes") if several else sized.where("doc_id is not null")
    # equal sets are represented by the smallest of their doc_ids
    alike = nodes.where("n > 0").groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("whole", "rep")
    alike = written(alike, "alike")  # a plain table on either side, so that a digest of many rows can be split or broadcast
    copies = written(nodes.join(_small(alike), "whole").where("doc_id <> rep").select("doc_id", "rep"), "copies")
    one = one.join(_small(copies.select("doc_id")), "doc_id", "left_anti")
    plan = Plan(percent, cheapest_boundary(nodes, percent))
    members = written(_centred(written(lists(keyed(one, k, plan)), "lists")), "members")
    sets = written(sets_of(one, members.select("doc_id").distinct(), k), "sets")

    # round one: each document with the most central of the centres of its lists
    centres = members.where("doc_id <> centre").groupBy("doc_id").agg(F.max(F.struct("score", "centre")).alias("c"))
    tested = written(_pairs(centres.selectExpr("c.centre as a", "doc_id as b")), "pairs")
    links = written(verified(tested, sets, percent), "links")
    # round two: each document with the centres of all its lists that are not connected to it
    now = _open(members, written(components(links), "labels"))
    pairs = now.where("label <> centre_label").selectExpr("centre as a", "doc_id as b")
    pairs = written(_pairs(pairs).join(tested, ["src", "dst"], "left_anti"), "pairs")
    links = written(links.union(verified(pairs, sets, percent)), "links")
    tested = tested.union(pairs)
    # round three: what is still apart, without the centres, and what sketches allow of it
    now = written(_open(members, written(components(links), "labels")).where("doc_id <> centre"), "open")
    odd = written(sketches(sets.join(_small(now.select("doc_id").distinct()), "doc_id", "left_semi"), plan), "sketches")
    a = now.selectExpr("key", "doc_id", "n as n1", "label as l1").join(odd, "doc_id").withColumnsRenamed({"doc_id": "a", "odd": "o1"})
    b = a.withColumnsRenamed({"a": "b", "n1": "n2", "l1": "l2", "o1": "o2"})
    allowed = f"n1 + n2 - 2 * cast(ceil({percent} * (n1 + n2) / {100 + percent}) as int)"
    close = f"a < b and l1 <> l2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {differing_sql('o1', 'o2')} <= {allowed}"
    pairs = a.join(b, "key").where(close).select("a", "b")
    pairs = written(_pairs(pairs).join(tested, ["src", "dst"], "left_anti"), "pairs")
    links = written(links.union(verified(pairs, sets, percent)), "links")

    labels = components(links).withColumnRenamed("id", "node")
    own = copies.selectExpr("doc_id", "rep as node").union(nodes.join(_small(copies.select("doc_id")), "doc_id", "left_anti").selectExpr("doc_id", "doc_id as node"))
    component = own.join(labels, "node", "left").selectExpr("doc_id", "coalesce(component, node) as component_id")
    result = sized.where("doc_id is not null").select("doc_id", "n").join(component, "doc_id")
    lone = sized.where("doc_id is null").selectExpr("doc_id", "n as n_shingles", "doc_id as component_id")
    return result.selectExpr("doc_id", "n as n_shingles", "component_id").union(lone)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("a <> b").selectExpr("least(a, b) as src", "greatest(a, b) as dst").distinct()


def _centred(members: DataFrame) -> DataFrame:
    """Members of lists of two and more (key, doc_id, n, own) with the centre of each list and its score.

    A document's score is the sum of the lengths of its lists: what most copies have in common makes long lists, so the
    centre of a list is a text that most of its members resemble.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = members.join(sizes, "key")
    scores = sized.groupBy("doc_id").agg(F.sum("size").alias("own"))
    scored = sized.join(scores, "doc_id")
    centres = scored.groupBy("key").agg(F.max(F.struct("own", (-F.col("doc_id")).alias("i"))).alias("c")).selectExpr("key", "c.own as score", "-c.i as centre")
    return scored.join(centres, "key").select("key", "doc_id", "n", "own", "centre", "score")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of the lists that hold documents of several components."""
    now = members.join(labels.selectExpr("id as doc_id", "component"), "doc_id", "left").selectExpr("key", "doc_id", "n", "own", "centre", "coalesce(component, doc_id) as label")
    at_centre = F.min(F.when(F.col("doc_id") == F.col("centre"), F.col("label")))
    several = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), at_centre.alias("centre_label")).where("low < high").select("key", "centre_label")
    return now.join(several, "key")
