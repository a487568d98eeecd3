import hashlib
import random

import pytest

fim = pytest.importorskip("confluo.llm.fill_middle")


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n, sha = len(text), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    x, y = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:x], text[x:y], text[y:]
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if d % 100 < 20 else "psm", x, y - x, sha(out), sha(text))


def texts():
    pick = random.Random(3)
    letters = "ab <>PSM\n\té́漢😀 "
    found = [None, "", "a", "<P>", "<<P>", "<P", "P>", "<S<M>", "😀", "\n\n", "x" * 100_000 + "é" * 50_000]
    return found + ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 300))) for _ in range(400)]


def test_equal_to_slicing_by_code_points(spark):
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts())] * 2
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, form string, n long").repartition(3)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, fim.digests(df).collect()), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_output_gives_the_text_back(spark):
    rows = list(enumerate(texts()))
    for unit in ("characters", "words", "lines"):
        got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, markers=("⟨pre⟩", "[suf]", "{mid}"), cut_percent=100).collect()
        assert {r.form for r in got} == {"plain", "psm", "spm"}
        for r in got:
            text = rows[r.doc_id][1] or ""
            assert fim.restored(r.output.encode(), r.form, ("⟨pre⟩", "[suf]", "{mid}")).decode() == text
            assert r.n == {"characters": len(text), "words": len([w for w in text.encode().split() if w]), "lines": len(text.split("\n")) if text and not text.endswith("\n") else text.count("\n")}[unit]


def test_ranks_and_markers():
    pick = random.Random(5)
    for width in (1, 63, 64, 65, 1000, 4097):
        bits = pick.getrandbits(width) | 1
        at = [i for i in range(width) if bits >> i & 1]
        ranks = sorted(pick.choices(range(len(at)), k=5))
        assert fim.places(bits, width, ranks) == [at[r] for r in ranks]
    for t in texts():
        raw = (t or "").encode()
        assert fim.holds(raw, fim.MARKERS) == any(m.encode() in raw for m in fim.MARKERS)


def test_overlapping_markers_are_refused(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for markers in (("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>x", "P", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, markers=markers)
    assert fim.fill_in_middle(df).count() == 0 and fim.digests(df).count() == 0
