import hashlib
import random
import zlib
from collections import Counter

import pytest

merge = pytest.importorskip("confluo.llm.branch_merge")
from pyspark.sql import functions as F

ENDS = {1: "!", 2: "?"}
ADDS = {3: "!", 4: "?"}


def edit(branch, doc_id, name):
    return 11 if doc_id is None else zlib.crc32(f"{branch}:{doc_id}:{name}".encode()) % 11


def three_way(base, left, right):
    """(merged, clean, conflict)"""
    if left == base and right == base:
        return base, 0, 0
    if left == base or right == base or left == right:
        return (right if left == base else left), 1, 0
    return base, 0, 1


def brute(rows):
    out, added = [], {}
    for doc_id, lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        n, changed = Counter(), {"L": 0, "R": 0}
        cells = []
        for name, v in (("lang", lang), ("source", source)):
            new = {b: "" if (c := edit(b, doc_id, name)) == 0 else v + ENDS.get(c, "") for b in "LR"}
            value, clean, conflict = three_way(v, new["L"], new["R"])
            cells.append(value)
            n["clean"] += clean
            n["ee"] += conflict
            for b in "LR":
                changed[b] += new[b] != v
        lines = []
        for i, line in enumerate(text.split("\n")):
            c = {b: edit(b, doc_id, i) for b in "LR"}
            new = {b: None if c[b] == 0 else line + ENDS.get(c[b], "") for b in "LR"}
            gap = {b: ADDS.get(c[b]) for b in "LR"}
            value, clean, conflict = three_way(line, new["L"], new["R"])
            lines += [value] if value is not None else []
            n["clean"] += clean
            n["ed" if None in new.values() else "ee"] += conflict
            value, clean, conflict = three_way(None, gap["L"], gap["R"])
            lines += [value] if value is not None else []
            n["clean"] += clean
            n["ii"] += conflict
            for b in "LR":
                changed[b] += c[b] <= 4
        gone = {b: edit(b, doc_id, "row") == 0 for b in "LR"}
        if gone["L"] or gone["R"]:
            disputed = not all(gone.values()) and changed["R" if gone["L"] else "L"]
            state, n = ([lang, source, text], Counter(ed=1)) if disputed else ([None] * 3, Counter(clean=1))
        else:
            state = [*cells, "\n".join(lines)]
        out.append((doc_id, *state, n["clean"], n["ee"], n["ed"], n["ii"]))
        for b, step in (("L", -1), ("R", -2)):
            if doc_id is not None and (c := edit(b, doc_id, "row")) in ADDS:
                sides = added.setdefault(step - doc_id, {})
                sides[b] = min(sides.get(b, ("~",)), (ADDS[c], lang, source))
    for doc_id, sides in added.items():
        values = set(sides.values())
        text, lang, source = min(values) if len(values) == 1 else (None,) * 3
        out.append((doc_id, lang, source, text, int(len(values) == 1), 0, 0, int(len(values) > 1)))
    return sorted(((r[0], r[1], r[2], None if r[3] is None else hashlib.sha256(r[3].encode()).hexdigest(), *r[4:]) for r in out), key=repr)


def frame(spark, rows):
    wide = [(*r, "x", ["y"]) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, lang string, source string, text string, states string, fate array<string>").repartition(3)


def random_rows(n):
    pick = random.Random(7)
    line = lambda: pick.choice(["", "a", "é\t", "!", "😀 b", " "])
    for k in range(n):
        text = pick.choice([None, "", "\n", "\n".join(line() for _ in range(pick.randrange(1, 40)))])
        yield (k, pick.choice([None, "", "en"]), pick.choice([None, "src", "!"]), text)


def test_equal_to_brute_force(spark):
    rows = list(random_rows(1500)) + [(None, "en", "s", "a\nb")] * 2 + [(5_000_000, "en", None, "long\n" * 30_000)]
    got = sorted(map(tuple, merge.digests(merge.merge(frame(spark, rows))).collect()), key=repr)
    assert got == brute(rows)
    assert all(sum(r[k] for r in got) > 5 for k in (4, 5, 6, 7))


def test_repeated_rows_and_empty_table(spark):
    rows = [(k, lang, "s", "a\nb") for k in range(200) for lang in ("en", "de", "en")]
    assert sorted(map(tuple, merge.digests(merge.merge(frame(spark, rows))).collect()), key=repr) == brute(rows)
    assert merge.merge(frame(spark, [])).count() == 0


def test_other_rules(spark):
    """A rule of its own: the left branch marks every line, the right one drops lines that the rule names."""

    def rule(branch, doc_id, name):
        if branch == "mine":
            return F.when(name.isin("lang", "source", "row"), 9).otherwise(merge.MARK)
        return F.when(name == "1", merge.DROP).when(name == "0", merge.ADD_ASK).otherwise(9)

    got = merge.merge(frame(spark, [(1, "en", "s", "a\nb\nc")]), ("mine", "theirs"), rule).collect()
    assert [tuple(r) for r in got] == [(1, "en", "s", "a!\n?\nb\nc!", 3, 0, 1, 0)]


def test_lines_stay_in_their_row(spark):
    plan = merge.merge(frame(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
