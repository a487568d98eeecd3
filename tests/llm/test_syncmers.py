import hashlib
import random

import pytest

syncmers = pytest.importorskip("confluo.llm.syncmers")


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, sketch string")
    return {r["doc_id"]: r for r in syncmers.edited(df).collect()}


def text(k, n):
    rng = random.Random(k)
    return " ".join(f"w{rng.randrange(997)}é" for _ in range(n))


def test_edits_and_neighbours(spark):
    rows = [(k * 3, text(k, 40 + 5 * k)) for k in range(30)] + [(1000, text(3, 55)), (1001, text(3, 55)), (1002, ""), (1003, None), (1004, "one two")]
    got = run(spark, rows)
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[1000]["near_next"] == 1 and got[1000]["fingerprint"] == got[1001]["fingerprint"]
    assert got[1002]["near_next"] == 1 and got[1002]["fingerprint"] == ""
    assert sum(got[k * 3]["near_edited"] > got[k * 3]["near_next"] for k in range(29)) >= 27


def test_anchors_are_context_free(spark):
    passage = text(5, 30)
    df = spark.createDataFrame([(1, passage), (2, "before it " + passage + " after it")], "doc_id long, text string")
    found = syncmers.anchors(df).collect()
    a = {(r["pos"], r["hash"]) for r in found if r["doc_id"] == 1}
    b = {(r["pos"] - 2, r["hash"]) for r in found if r["doc_id"] == 2}
    assert a and a <= b


def test_closed_syncmers_same_as_brute_force(spark):
    words = text(2, 60).split(" ")
    h = {w: spark.range(1).selectExpr(f"xxhash64('{w}')").first()[0] for w in set(words)}
    pairs = {(a, b): spark.range(1).selectExpr(f"xxhash64({h[a]}L, {h[b]}L)").first()[0] for a, b in set(zip(words, words[1:]))}
    m = [pairs[p] for p in zip(words, words[1:])]
    want = [i for i in range(len(words) - 4) if min(m[i : i + 4]) in (m[i], m[i + 3])]
    got = syncmers.anchors(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [r["pos"] for r in got] == want


def test_table_cases(spark):
    rows = [(1, "b"), (1, "a"), (None, text(1, 9)), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_chars"], r["near_next"]) for r in syncmers.edited(df).collect()), key=str)
    assert got == [(1, 1, 0.0), (2, 0, 0.0), (None, len(text(1, 9)), None)]
    assert syncmers.edited(df.limit(0)).count() == 0
    one = syncmers.edited(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1


def brute(text, h, pair, five):
    """Sorted smallest distinct hashes of the closed syncmers of a text."""
    words = (text or "").split()
    if len(words) < 5:
        return None
    m = [pair[p] for p in zip(words, words[1:])]
    chosen = [i for i in range(len(words) - 4) if min(m[i : i + 4]) in (m[i], m[i + 3])]
    return sorted({(five[tuple(words[i : i + 5])] % (1 << 64)) >> 16 for i in chosen})[: syncmers.SKETCH]


def test_fingerprints_and_likeness_same_as_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    rows = [(k, " ".join(base[a:b])) for k, (a, b) in enumerate([(0, 300), (10, 310), (100, 400), (0, 40), (5, 45), (0, 5), (200, 400)])]
    texts = [t for _, t in rows]
    halves = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    words = [t.split() for t in texts + halves]
    df = spark.createDataFrame([(w,) for w in sorted({w for own in words for w in own})], "w string")
    h = dict(map(tuple, df.selectExpr("w", "xxhash64(w)").collect()))
    df = spark.createDataFrame([(a, b, h[a], h[b]) for a, b in sorted({p for own in words for p in zip(own, own[1:])})], "a string, b string, x long, y long")
    pair = {(r[0], r[1]): r[2] for r in df.selectExpr("a", "b", "xxhash64(x, y)").collect()}
    df = spark.createDataFrame([(list(g), [h[w] for w in g]) for g in sorted({tuple(own[i : i + 5]) for own in words for i in range(len(own) - 4)})], "g array<string>, x array<long>")
    five = {tuple(r[0]): r[1] for r in df.selectExpr("g", "xxhash64(x[0], x[1], x[2], x[3], x[4])").collect()}

    def likeness(a, b):
        union = sorted(set(a) | set(b))[: syncmers.SKETCH]
        return len(set(union) & set(a) & set(b)) / len(union)

    got = run(spark, rows)
    prints = [brute(t, h, pair, five) for t in texts]
    for k, t in enumerate(texts):
        edited = brute(halves[k], h, pair, five)
        assert got[k]["fingerprint"] == "".join(f"{x:012x}" for x in prints[k])
        assert got[k]["edited_fingerprint"] == "".join(f"{x:012x}" for x in edited)
        assert abs(got[k]["near_edited"] - likeness(prints[k], edited)) < 1e-9 and abs(got[k]["near_next"] - likeness(prints[k], prints[(k + 1) % len(prints)])) < 1e-9


def test_positional_matching(spark):
    passage = text(5, 60)
    docs = spark.createDataFrame([(1, "a b c " + passage + " tail"), (2, text(6, 80)), (None, passage), (4, None)], "doc_id long, text string")
    found = syncmers.passages(spark.createDataFrame([(9, passage)], "doc_id long, text string"), docs).collect()
    best = max(found, key=lambda r: r["n"])
    assert (best["doc_id"], best["other_id"], best["shift"]) == (9, 1, 3) and best["n"] > 15
    assert all(r["other_id"] == 1 for r in found)


def test_ranges_are_found_by_halving(spark):
    from confluo.llm.common import range_of

    for points in ([], [5], [1, 5, 9], list(range(0, 900, 7))):
        got = spark.range(-3, 1000).select("id", range_of("id", points).alias("r")).collect()
        assert all(r["r"] == sum(p <= r["id"] for p in points) for r in got)


def test_very_long_texts(spark):
    rows = [(1, text(1, 60_000)), (2, "x" * 400_000), (3, "same " * 80_000)]
    got = run(spark, rows)
    assert [got[k]["n_chars"] for k in (1, 2, 3)] == [len(t) for _, t in rows] and len(got[1]["fingerprint"]) == 12 * syncmers.SKETCH
