import itertools
import random

import numpy as np
import pytest

compact = pytest.importorskip("confluo.llm.compact")


def test_windows_same_as_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n, length = rng.randint(0, 40), rng.randint(2, 9)
        h = [rng.randrange(0, rng.choice([3, 8, 1000])) for _ in range(n)]
        want = set()
        for i in range(n):
            for j in range(i + length - 1, n):
                if 0 in h[i : j + 1]:
                    break
                c = i + int(np.argmin(h[i : j + 1]))
                want.add((i, c, j))
        got = set()
        for l, c, r in zip(*(x.tolist() for x in compact.compact_windows(np.array(h, np.uint64), length))):
            got |= {(i, c, j) for i in range(l, c + 1) for j in range(c, r + 1) if j - i + 1 >= length}
        assert got == want


def words(rng, n):
    return ["v%d" % rng.randrange(100_000) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(2)
    rows, classes = {}, {}
    for g in range(12):
        passage = words(rng, rng.randint(51, 150))
        members = [g * 10 + k for k in range(rng.randint(2, 4))]
        for m in members:
            own = list(passage)
            for _ in range(len(own) // 60 if m % 2 else 0):
                own[rng.randrange(len(own))] = "edited"
            rows[m] = " ".join(words(rng, rng.randint(0, 80)) + own + words(rng, rng.randint(0, 80)))
            classes[m] = members[0]
    line = words(rng, 20)
    for d in range(500, 560):  # a common line is no passage
        rows[d] = " ".join(words(rng, 60) + line + words(rng, 60))
        classes[d] = d
    rows |= {900: None, 901: "", 902: "too short"}
    classes |= {900: 900, 901: 901, 902: 902}
    df = spark.createDataFrame([(d, t, 1) for d, t in rows.items()], "doc_id long, text string, part int").repartition(5)
    got = {r["doc_id"]: r for r in compact.classes(df).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == classes
    assert all((r["n_passages"] > 0) == (sum(c == r["class_id"] for c in classes.values()) > 1) for r in got.values())
    for d, r in got.items():
        for p in r["passages"]:
            assert p["end"] - p["begin"] >= 50 and p["end"] <= len((rows[d] or "").split())


def test_many_copies_and_streams(spark):
    rng = random.Random(5)
    passage = words(rng, 80)
    rows = [(d, " ".join(words(rng, 30) + passage + words(rng, 30))) for d in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in compact.classes(df).collect()} == {0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_table_cases(spark):
    rng = random.Random(6)
    t = " ".join(words(rng, 90))
    rows = [(1, t), (1, t), (None, t), (2, t), (3, None)]
    got = sorted(((r["doc_id"], r["class_id"], r["n_words"]) for r in compact.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 1, 90), (2, 1, 90), (3, 3, 0), (None, None, 0)]
    assert compact.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_in_two_distant_halves():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 30, 100).astype(np.uint32)
    gap = rng.integers(1 << 30, 1 << 31, 500).astype(np.uint32)
    assert compact.alike(a, np.concatenate([a[:50], gap, a[50:]]), 60) == []
    assert compact.alike(a, np.concatenate([gap, a]), 60) == [(0, 100, 500, 600)]


def test_few_windows_of_one_hash_all_meet(spark):
    # centre 60, with 60 places on one side of it
    rows = [(7, (1 + d // 5) << 32 | (60 << 16 if d % 2 else 60), d, 60) for d in range(10)]
    df = spark.createDataFrame(rows, compact.ROWS)
    got = {(r["src"], r["dst"]) for r in compact.joined(df, 46).collect()}
    assert got == {(a, b) for a in range(10) for b in range(a + 1, 10) if (a - b) % 2 == 0}


@pytest.mark.parametrize("size", [30, 40])
def test_frequent_line_inside_pairwise_passages(spark, size):
    rng = random.Random(size)
    line = words(rng, size)
    rows = [(d, " ".join(words(rng, 60) + line + words(rng, 60))) for d in range(100, 500)]
    want = {d: d for d, _ in rows}
    for g in range(50):  # 55 words around the line that only two documents share
        left = rng.randint(0, 55 - size)
        passage = words(rng, left) + line + words(rng, 55 - size - left)
        for d in (1000 + g, 2000 + g):
            rows.append((d, " ".join(words(rng, 40) + passage + words(rng, 40))))
            want[d] = 1000 + g
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in compact.classes(df).collect()} == want


def test_phrase_with_passages_on_either_side_in_one_slice(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(40):
        phrase, right = words(rng, 40), words(rng, 14)
        left = " ".join(words(rng, 60) + phrase + words(rng, 3))
        both = [" ".join(words(rng, 40) + phrase + right + words(rng, 40)) for _ in range(2)]
        rows += [(3 * g + k, t) for k, t in enumerate([left, *both])]
        want |= {3 * g: 3 * g, 3 * g + 1: 3 * g + 1, 3 * g + 2: 3 * g + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["class_id"] for r in compact.classes(df).collect()} == want


def passage_pairs(rows, words=50):
    """Pairs of documents whose best aligned passage of ``words`` words keeps 0.8 of its 5-word shingles, by brute force over shifts."""
    shingles = {d: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for d, t in rows for w in [t.split()]}
    n, pairs = words - 4, set()
    for (a, x), (b, y) in itertools.combinations(sorted(shingles.items()), 2):
        common = set(x) & set(y)
        if 9 * len(common) < 8 * n // 2:
            continue
        for s in {j - i for i, g in enumerate(x) if g in common for j, h in enumerate(y) if g == h}:
            same = [0 <= i + s < len(y) and x[i] == y[i + s] for i in range(len(x))]
            if any(9 * sum(same[i : i + n]) >= 8 * n and 0 <= i + s and i + s + n <= len(y) for i in range(len(x) - n + 1)):
                pairs.add((a, b))
                break
    return pairs


def recall(spark, rows):
    """Share of the pairs found by brute force whose documents are of one class, and of classes that hold no such pair."""
    pairs = passage_pairs(rows)
    got = {r["doc_id"]: r["class_id"] for r in compact.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return sum(got[a] == got[b] for a, b in pairs) / len(pairs), got, pairs


def test_recall_in_a_large_group_of_edited_passages(spark):
    """Two hundred documents share a passage of 60 words, each with one word changed."""
    rng = random.Random(12)
    passage, rows = ["p%d" % k for k in range(60)], []
    for d in range(200):
        own = list(passage)
        own[rng.randrange(60)] = "edit%d" % d
        rows.append((d, " ".join(["a%dx%d" % (d, k) for k in range(rng.randrange(10, 40))] + own + ["z%dx%d" % (d, k) for k in range(rng.randrange(10, 40))])))
    found, _, _ = recall(spark, rows)
    assert found >= 0.9, found


def test_recall_of_pairs_around_a_frequent_line(spark):
    """All documents hold one line of 30 words; some pairs share the words around it as well."""
    rng = random.Random(13)
    line, rows = ["line%d" % k for k in range(30)], []
    for d in range(300):
        pair = d // 2 if d < 80 else 1000 + d
        a, b = ["l%dx%d" % (pair, k) for k in range(13)], ["r%dx%d" % (pair, k) for k in range(13)]
        rows.append((d, " ".join(["s%dx%d" % (d, k) for k in range(rng.randrange(5, 30))] + a + line + b + ["t%dx%d" % (d, k) for k in range(rng.randrange(5, 30))])))
    found, got, pairs = recall(spark, rows)
    assert len(pairs) == 40 and found >= 0.9, found
    assert all(got[d] == d for d in range(80, 300))


def test_shuffle_files_go_as_a_table_is_written(spark):
    """The steps' shuffle files add up to more than the disk limit unless each step drops its own."""
    import gc
    import time

    from confluo.llm.common import written

    def held():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    gc.disable()
    try:
        before = held()
        df = spark.range(20_000).selectExpr("id", "id % 7 as key").repartition(5, "key").groupBy("key").sum("id")
        kept = written(df, "dropped", drop_shuffles=True)
        for _ in range(50):
            if not held() - before:
                break
            time.sleep(0.1)
        assert not held() - before
        assert kept.count() == 7
    finally:
        gc.enable()


def test_no_cap_for_a_frequent_run(spark):
    """The cheap rounds compare a first with the BACK firsts before it: pairs of places they leave apart are all given by rest."""
    rng = random.Random(21)
    line = words(rng, 30)
    rows = []
    for d in range(120):
        pair = d % 60
        own = random.Random(1000 + pair)
        left, right = words(own, 12), words(own, 12)
        right[d // 60] = "edit%d" % d
        rows.append((d, " ".join(words(rng, 40) + left + line + right + words(rng, 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame([(d, 5, 56) for d in range(120)], "doc_id long, key long, at int")
    none = spark.createDataFrame([], "id long, component long")
    got = {(r["src"], r["dst"]) for r in compact.rest(docs, many, none, 46).collect()}
    assert got == {(d, d + 60) for d in range(60)}
    # of those already of one class nothing is left
    one = spark.createDataFrame([(d, d % 60) for d in range(120)], "id long, component long")
    assert compact.rest(docs, many, one, 46).isEmpty()


def test_repeats_around_a_frequent_run_do_not_pair_all(spark):
    """A line that documents hold several times stands twice around its places: what all have of it is still taken away."""
    rng = random.Random(22)
    line, rows, many = words(rng, 30), [], []
    for d in range(60):
        own = random.Random(1000 + d % 59)  # the last one has the first one's words
        gaps = [words(own, 25) for _ in range(3)]
        text = words(rng, 40)
        for gap in gaps:
            many.append((d, 5, len(text) + 4))
            text += line + gap
        rows.append((d, " ".join(text + words(rng, 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "id long, component long")
    got = compact.rest(docs, spark.createDataFrame(many, "doc_id long, key long, at int"), none, 46).collect()
    assert {(r["src"], r["dst"]) for r in got} == {(0, 59)}


def test_places_of_few_different_shingles_are_alike(spark):
    """What passages must have in common goes by their different shingles: words over and over, with one changed."""
    rng = random.Random(23)
    rows = []
    for d in range(40):
        own = words(random.Random(2000 + d % 20), 24)
        text = own * 3
        if d >= 20:
            text[-30] = "edit%d" % d
        rows.append((d, " ".join(words(rng, 30) + text + words(rng, 30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame([(d, 5, k) for d in range(40) for k in (30, 34)], "doc_id long, key long, at int")
    none = spark.createDataFrame([], "id long, component long")
    got = {(r["src"], r["dst"]) for r in compact.rest(docs, many, none, 46).collect()}
    assert got == {(d, d + 20) for d in range(20)}


def test_least_kinds_same_as_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        own = rng.integers(0, int(rng.integers(1, 200)), int(rng.integers(0, 140))).astype(np.uint64)
        at = np.arange(max(0, len(own) - 16))
        for n in (46, 36, 17):
            cuts = [[len(set(own[s : s + n].tolist())) for s in range(max(0, x + 17 - n), min(x, len(own) - n) + 1)] for x in at.tolist()]
            assert compact._least_kinds(own, at, 17, n).tolist() == [min(c, default=0) for c in cuts]
