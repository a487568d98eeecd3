import hashlib
import random

import numpy as np
import pytest

suffix = pytest.importorskip("confluo.llm.suffix")


def brute(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(0, 60)
        s = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(n)]
        assert suffix.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def texts(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = ["", None, "short", "a" * (3 * length), "ab" * length, "a" * length]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        p = rng.choice(passage)
        cut = rng.randrange(len(p) // 2)
        parts.insert(1, rng.choice([p, p[cut:], p[: len(p) - cut], ""]))
        out.append(" ".join(parts))
    out += [out[10], out[10] + "tail", out[12]]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rows = texts(seed, 100)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(4)
    assert sorted(map(tuple, suffix.digests(df).collect())) == brute(rows, 100)


def test_heavy_groups_give_the_same(spark, monkeypatch):
    rows = texts(9, 100)
    found = []
    for n in range(60):  # one anchor in many surroundings
        rng = random.Random(n)
        found.append("".join(rng.choices("xyz", k=50)) + "0123456789" * 12 + "".join(rng.choices("xyz", k=50)))
    rows += list(enumerate(found, 1000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 100)
    assert sorted(map(tuple, suffix.digests(df).collect())) == want
    run = suffix.suffix_sorted
    source = {}

    def small(rows_, length, level):
        # the closures travel by value, so the limit is set where they are made
        suffix.HEAVY_BYTES = 500
        try:
            source["df"] = run(rows_, length, level)
            return source["df"]
        finally:
            pass

    monkeypatch.setattr(suffix, "HEAVY_BYTES", suffix.HEAVY_BYTES)
    monkeypatch.setattr(suffix, "suffix_sorted", small)
    assert sorted(map(tuple, suffix.digests(df).collect())) == want
    monkeypatch.setattr(suffix, "HOT_ROWS", 3)
    for levels in (1, 2):  # strings that no anchor tells apart are compared by hash
        monkeypatch.setattr(suffix, "LEVELS", levels)
        assert sorted(map(tuple, suffix.digests(df).collect())) == want


def test_division_keeps_equal_strings_together():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcd", k=30)) + "0123456789" * 9 + "".join(rng.choices("abcd", k=30)) for _ in range(40)]
    rows = [(5, k, 0, len(t) - 99, t.encode()) for k, t in enumerate(texts + texts[:9])]
    strings, keys = {}, {}
    for key, doc, start, n, raw in suffix.divided(rows, 100, 1):
        assert raw == rows[doc][4][start : start + n + 99]
        for j in range(n):
            strings.setdefault(raw[j : j + 100], set()).add(key)
            keys.setdefault((doc, start + j), []).append(key)
    assert all(len(k) == 1 for k in strings.values()) and all(len(k) == 1 for k in keys.values())
    assert sum(len(t) - 99 for t in texts + texts[:9]) == len(keys)


def test_groups_over_batch_borders():
    import pyarrow as pa

    rng = random.Random(6)
    rows = sorted((rng.randrange(12), rng.randrange(3), rng.randrange(5), k) for k in range(120))
    rows = [(*r, 1, 0) for r in rows]
    names = ["key", "around", "doc_id", "start", "n", "back"]
    again, firsts, seen, by = [], [], set(), {}
    for r in rows:
        if r[:2] in seen:
            again.append(r)
        else:
            by.setdefault(r[0], []).append(r)
        seen.add(r[:2])
    firsts = [r for own in by.values() if len(own) > 1 for r in own]
    for size in (1, 2, 5, 120):
        groups, got = suffix._Groups(), ([], [])
        for at in range(0, len(rows), size):
            cols = list(zip(*rows[at : at + size]))
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
            for sink, found in zip(got, groups.step(batch)):
                for b in found:
                    sink += list(zip(*(c.to_pylist() for c in b.columns)))
        assert sorted(got[0]) == sorted(again) and sorted(got[1]) == sorted(firsts)


def test_table_cases(spark):
    long = "abcdefghij" * 15
    rows = [(2, long), (2, long), (None, long), (1, long), (3, None)]
    got = sorted(map(tuple, suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = brute([(1, long), (2, long), (3, None)], 100) + [(None, 150, 0, 0, hashlib.sha256(long.encode()).hexdigest())]
    assert got == sorted(want, key=str)
    assert suffix.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
