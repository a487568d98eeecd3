"""Search against the plain rules, on folded Chinese and Latin texts."""

import random
import re

from confluo.operators import search

NOW = 1000


def fold(s):
    return re.sub(r"\s", "", (s or "").replace("台", "臺")).lower()


def variants(q, names):
    v = fold(q)
    return {v} | {v.replace(fold(a), fold(n), 1) for n, _, _, aliases in names for a in aliases or [] if fold(a) and fold(a) in v}


def order(r):
    slug, start, end = r[0], r[5], r[6]
    stop = end if end is not None else start
    if start is None:
        return (2 if stop is not None and stop < NOW else 1, -(10**9), slug, -(10**9))
    return (2, -start, slug, start) if stop < NOW else (0, stop, slug, start) if start < NOW else (1, start, slug, start)


def brute(rows, queries, names, limit):
    out = []
    for q in {q for q in queries if q is not None and fold(q)}:
        hits = sorted((r for r in rows if any(x in fold("".join(v or "" for v in r[1:5])) for x in variants(q, names))), key=order)
        out += [(q, len(hits), k + 1, r[0], r[5]) for k, r in enumerate(hits[:limit])]
    return sorted(out)


def data():
    pick = random.Random(8)
    words = ["台中", "臺中", "國家", "歌劇院", "展 覽", "Fair", "音樂", "a", "親子", "市集"]
    text = lambda n: pick.choice([None, *("".join(pick.choices(words, k=n)) for _ in range(6))])
    rows = []
    for k in range(400):
        start = pick.choice([900, 990, 1000, 1100, 1500])
        rows.append((f"e{k:03}", text(2), text(2), text(1), None, start, pick.choice([None, start, start + 50, start + 500])))
    rows += [(f"h{k:03}", "熱門 市集", "Hall", "台北", None, 1200 + k, None) for k in range(120)]
    names = [("臺中國家歌劇院", "ntt", 2, ["台中歌劇院", "歌劇院", ""]), ("Hall", "hall", 1, ["HALL one"]), ("音樂", "m", 3, None), ("市集", "f", 3, [])]
    queries = ["台中歌劇院", " 臺中 ", "FAIR", "a", "歌劇院音樂", "熱門市集hall", "", "  ", None, "不存在", "音樂音樂", "市", "親子 市集", "親子 市集"]
    return rows, names, queries


def frames(spark, rows, names, queries):
    return (
        spark.createDataFrame([(*r, "x") for r in rows], "slug string, title string, venue string, city string, cat string, start long, end long, hay string").repartition(3),
        spark.createDataFrame(names, "name string, slug string, position int, aliases array<string>"),
        spark.createDataFrame([(q,) for q in queries], "query string"),
    )


def test_same_as_plain_rules(spark, tmp_path):
    rows, names, queries = data()
    r, n, q = frames(spark, rows, names, queries)
    index = search.Index.build(r, str(tmp_path / "index"), NOW)
    assert sorted(map(tuple, search.search(index, q, n).collect())) == brute(rows, queries, names, 40)
    assert sorted(map(tuple, search.search(index, q, limit=7).collect())) == brute(rows, queries, [], 7)
    again = search.Index(spark, str(tmp_path / "index"))
    assert again.texts.agg({"n": "sum"}).first()[0] == len(rows) and again.texts.where("size(rows) > 40").count() == 0


def test_venues_both_ways(spark):
    _, names, queries = data()
    _, n, q = frames(spark, [], names, queries)
    want = []
    for text in {x for x in queries if x is not None and fold(x)}:
        v = fold(text)
        hits = [(p, s, name) for name, s, p, aliases in names if any(k and (v in k or (len(v) >= 2 and k in v)) for k in map(fold, [name, *(aliases or [])]))]
        want += [(text, k + 1, name, s) for k, (_, s, name) in enumerate(sorted(hits)[:2])]
    assert sorted(map(tuple, search.search_venues(q, n, limit=2).collect())) == sorted(want)


def test_empty_tables(spark, tmp_path):
    r, n, q = frames(spark, [], [], [])
    index = search.Index.build(r, str(tmp_path / "index"), NOW)
    assert search.search(index, q, n).count() == 0 and search.search_venues(q, n).count() == 0
