import itertools
import random

import numpy as np
import pytest

ngram_join = pytest.importorskip("confluo.llm.ngram_join")


def shingles(text, k=4):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split() if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "e%d" % rng.randrange(10**6)
    return words


def make(seed):
    rng = random.Random(seed)
    out = ["", None, " \n\t ", "one", "One", "two words", "a b c", "A b  c"]
    line = "the common line of many documents here".split()
    for _ in range(25):
        n = rng.choice([1, 3, 5, 6, 8, 9, 10, 12, 14, 17, 20, 25, 40, 90, 200])
        base = ["w%d" % rng.randrange(5000) for _ in range(n)]
        for _ in range(rng.randint(1, 6)):
            own = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))
            if rng.random() < 0.3:
                own += ["x%d" % rng.randrange(99)] * rng.randint(1, 3)
            if rng.random() < 0.3:
                own = line + own
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rows = make(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n long, key string").repartition(5)
    assert sorted(map(tuple, ngram_join.linked(df).collect())) == brute(rows)


def test_chain_of_near_copies(spark):
    """Neighbours link, ends do not; all are one component."""
    words = ["w%d" % k for k in range(60)]
    rows = [(k, " ".join(words[k : k + 50])) for k in range(10)] + [(100, "zz " * 30)]
    assert sorted(map(tuple, ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_table_cases(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D e")]
    got = sorted(map(tuple, ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_qualifying_pairs_share_a_key(percent):
    rng = random.Random(percent)
    plans = [ngram_join.Plan(percent, light) for light in (0, 3, 6, 9)]
    for _ in range(600):
        plan = rng.choice(plans)
        n = rng.randint(1, 60)
        base = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        other = set(base.tolist())
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.5 and len(other) > 1:
                other.remove(rng.choice(sorted(other)))
            else:
                other.add(rng.getrandbits(64))
        other = np.array(sorted(other), np.uint64)
        both = len(np.intersect1d(base, other))
        if 100 * both >= percent * (len(base) + len(other) - both):
            assert len(np.intersect1d(plan.keys(base), plan.keys(other)))


def test_lists_over_batch_borders(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(150), k, 1) for k in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted(map(tuple, ngram_join.lists(spark.createDataFrame(rows, "key long, doc_id long, n int")).collect()))
            by = {}
            for r in rows:
                by.setdefault(r[0], []).append(r)
            assert got == sorted(r for own in by.values() for r in own if len(own) > 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_sketches_count_differences(spark):
    """Sketches of different lengths never overstate the difference, and come close to it within the threshold."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    rows, want = [], {}
    for k, d in enumerate([0, 1, 5, 40, 100, 300]):
        other = np.unique(np.concatenate([base[d:], rng.integers(0, 1 << 63, d).astype(np.uint64)]))
        want[k] = len(np.setxor1d(base, other))
        rows.append((k, ngram_join.odd_sketch(base, 64).tolist(), ngram_join.odd_sketch(other, 128).tolist()))
        rows.append((k, ngram_join.odd_sketch(base).tolist(), ngram_join.odd_sketch(other).tolist()))
    got = spark.createDataFrame(rows, "k int, a array<long>, b array<long>").selectExpr("k", "size(b) as n", f"{ngram_join.differing_sql('a', 'b')} as d").collect()
    for r in got:
        assert r["d"] <= want[r["k"]] and (r["n"] == 16 or r["d"] >= 0.8 * want[r["k"]])


def test_group_of_near_copies_without_a_centre(spark):
    """Many edits of one text: most pairs fall short, some link, and whoever links with anyone is found."""
    rng = random.Random(9)
    base = ["w%d" % k for k in range(150)]
    rows = [(k, " ".join(edited(rng, base, rng.randint(2, 9)))) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 40, 2)] + [(2000 + k, rows[k][1]) for k in range(30)]
    assert sorted(map(tuple, ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "z y x w v u"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "z y x w v u"), (4, None), (4, "")]
    got = sorted(map(tuple, ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 3), (4, 0, 4), (4, 0, 4)]


def test_boundary_follows_the_sets(spark):
    """Many small sets without copies are enumerated; the boundary never leaves the range weighed."""
    def boundary(rows):
        return ngram_join.cheapest_boundary(ngram_join.sizes(spark.createDataFrame(rows, "doc_id long, text string"), 4), 85)

    few = [(k, " ".join("w%d" % (k * 20 + j) for j in range(5 + k % 10))) for k in range(60)]
    assert 0 < boundary(few) <= ngram_join.MOST_LIGHT
    assert boundary([(1, None)]) == 0
