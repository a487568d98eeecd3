import itertools
import random

import pytest

decontaminate = pytest.importorskip("confluo.llm.decontaminate")


def words(rng, n):
    return ["q%d" % rng.randrange(3000) for _ in range(n)]


def test_finds_planted_overlaps(spark):
    rng = random.Random(1)
    items = [(k, words(rng, rng.randint(14, 50))) for k in range(20)]
    docs, want = [], set()
    for d in range(60):
        own = words(rng, rng.randint(0, 200))
        if d % 3 == 0:
            k, item = rng.choice(items)
            item = list(item)
            for _ in range(len(item) // 10):
                item[rng.randrange(len(item))] = "other"
            own[len(own) // 2 : len(own) // 2] = [w.upper() + rng.choice([",", ".", ""]) for w in item]
            want.add((d, k))
        docs.append((d, " ".join(own)))
    docs += [(100, None), (101, ""), (None, " ".join(items[0][1])), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(k, " ".join(w), 9) for k, w in items] + [(99, None, 1), (None, "a b", 1), (0, " ".join(items[0][1]), 1)], "item_id long, text string, doc_id long")
    got = decontaminate.overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    kept = {r["doc_id"] for r in decontaminate.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_insertion_joins_diagonals(spark):
    item = ["i%d" % k for k in range(40)]
    doc = item[:20] + ["new", "words"] + item[20:]
    r = decontaminate.overlaps(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).first()
    assert r["matched"] == 40 and r["first_word"] == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 1
    assert decontaminate.overlaps(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def windows(n):
    return [frozenset(i + j for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for i in range(n - len(m) + 1)]


@pytest.mark.parametrize("n", range(decontaminate.LEAST_WORDS, 19))
def test_no_substitution_hides_an_item(n):
    """All ways to change as many words of a short item as the threshold allows leave the windows that are needed."""
    needed = 2 if n >= decontaminate.SURE_WORDS else 1
    most = max(k for k in range(n) if n - k >= decontaminate.COVERAGE * n)
    for bad in itertools.combinations(range(n), most):
        assert sum(w.isdisjoint(bad) for w in windows(n)) >= needed


def test_same_as_comparing_every_diagonal(spark):
    """Items of all lengths with as many substitutions as allowed, and one more, against a comparison without seeds."""
    rng = random.Random(3)
    items = [["i%dn%d" % (k, j) for j in range(n)] for k, n in enumerate([5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30, 45] * 6)]
    docs, want = [], {}
    for k, item in enumerate(items):
        n = len(item)
        most = max(c for c in range(n) if n - c >= decontaminate.COVERAGE * n)
        bad = set(rng.sample(range(n), most + (k % 3 == 0)))
        docs.append((k, " ".join(["p"] * rng.randrange(5) + ["x%dn%d" % (k, j) if j in bad else w for j, w in enumerate(item)] + ["q"] * rng.randrange(5))))
        if n - len(bad) >= decontaminate.COVERAGE * n or n - len(bad) >= decontaminate.LONG_MATCH:
            want[k] = n - len(bad)
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert {r["doc_id"]: r["matched"] for r in got.collect()} == want


def test_very_long_and_repetitive_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "same " * 60_000), (2, "w1 w2 w3 " * 40_000 + item + " tail" * 10_000), (3, "x" * 500_000)]
    bench = [(1, item), (2, "same same same same same"), (3, "same " * 30)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched"], r["first_word"]) for r in got) == [(1, 2, 5, 0), (1, 3, 30, 0), (2, 1, 12, 120_000)]
