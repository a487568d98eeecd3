"""Names inside names, and heritage sites of venues, against plain loops."""

import math
import random
import re

from confluo.operators import containment

SCHEMA = "id string, name string, city string, district string, lat double, lng double"


def test_contained_keys_equal_comparing_all(spark):
    pick = random.Random(1)
    words = ["".join(pick.choices("abc文化", k=pick.randrange(0, 9))) for _ in range(300)]
    hay = ["".join(pick.choices("abc文化", k=pick.randrange(0, 14))) for _ in range(400)] + ["文化中心"] * 50 + [None]
    frame = lambda rows: spark.createDataFrame([(w, "x") for w in rows], "key string, gram string").repartition(3)
    for least in (1, 2, 4, 6):
        got = {tuple(r) for r in containment.contained_keys(frame([*words, None]), frame(hay), least).collect()}
        assert got == {(w, h) for w in words if len(w) >= least for h in hay if h and w in h}
    assert containment.contained_keys(frame([]), frame(hay)).count() == 0


def test_keys_of_a_heritage_name(spark):
    names = ["安平車站(原安平驛)", "東沙灣砲台(一級)", "（舊）郵局（四角樓）", "宅", None, ""]
    got = {}
    for r in containment.heritage_keys(spark.createDataFrame(list(enumerate(names)), "id int, name string")).collect():
        got.setdefault(r.id, set()).add(r.key)
    assert got == {0: {"安平車站原安平驛", "安平車站", "原安平驛"}, 1: {"東沙灣砲台一級", "東沙灣砲台"}, 2: {"舊郵局四角樓"}}


def metres(a, b):
    if None in (a[4], a[5], b[4], b[5]):
        return None
    la, lb = math.radians(a[4]), math.radians(b[4])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
    return math.floor(2 * 6371000 * math.asin(min(1, math.sqrt(s))) + 0.5)


def norm(name):
    return re.sub("^(國立|市立|縣立|私立)", "", re.sub(r"[\s\-–—_()（）]", "", name or "")).lower()


def keys(name):
    parts = [(name, 3), (re.sub("[（(][^）)]*[）)]", "", name), 3)] + [(x, 4) for x in re.findall("[（(]([^）)]+)[）)]", name)] if name else []
    return {norm(p) for p, n in parts if len(norm(p)) >= n}


def brute(heritages, venues, reject=(), link=()):
    out = [(h, v, "manual", 1.0, None) for h, v in link]
    for v in venues:
        key = norm(v[1])
        bare = re.sub("^(?:國定|直轄市定|市定|縣市定|縣定)?古蹟|^(?:歷史|紀念)建築", "", key)
        best = {}
        for h in heritages:
            if not key or (h[0], v[0]) in reject or v[0] in {x for _, x in link} or (h[2] and v[2] and h[2] != v[2]):
                continue
            d = metres(h, v)
            for k in keys(h[1]):
                if k in (key, bare):
                    rank = 2 if d is None or d <= 1000 else 0
                else:
                    rank = int(len(k) >= 4 and k in key and (d <= 300 if d is not None else bool(h[3] and h[3] == v[3] and len(k) >= 5)))
                if rank:
                    best[h[0]] = max(best.get(h[0], (0, 0, None)), (rank, len(k), d), key=lambda x: x[:2])
        top = sorted(best.items(), key=lambda x: x[1][:2])[-2:]
        if top and (len(top) == 1 or top[0][1][:2] != top[1][1][:2]):
            h, (rank, _, d) = top[-1]
            out.append((h, v[0], "exact-name" if rank == 2 else "name-contains", 0.9 if rank == 2 else 0.7, d))
    return sorted(out)


def run(spark, heritages, venues, reject=(), link=()):
    pairs = lambda x: spark.createDataFrame(list(x), "heritage_id string, venue_id string")
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (heritages, venues)]
    return sorted(map(tuple, containment.heritage_sites(*frames, pairs(reject), pairs(link)).collect()))


def test_stated_cases(spark):
    sites = [("h1", "臺中放送站", "臺中市", None, 24.14, 120.68), ("h2", "林家花園宅邸", "臺北市", "板橋區", 25.01, 121.45), ("h3", "文昌祠", "臺北市", None, 25.0, 121.0),
             ("h4", "四四新村", "臺北市", None, 25.031, 121.562), ("h5", "公民會館四四新村", "臺北市", None, 25.031, 121.562), ("h6", "北門郵局", None, None, None, None), ("h7", "北門郵局", None, None, None, None)]
    venues = [("near", "臺中放送站", "臺中市", None, 24.1401, 120.6801), ("status", "歷史建築臺中放送站", "臺中市", None, None, None), ("city", "臺中放送站", "臺北市", None, None, None), ("far", "臺中放送站", "臺中市", None, 24.2, 120.68),
              ("inside", "國定古蹟林家花園宅邸三落", "臺北市", None, 25.0101, 121.4501), ("away", "林家花園宅邸特展", "臺北市", None, 25.03, 121.46), ("district", "國立林家花園宅邸別館", "臺北市", "板橋區", None, None),
              ("other", "林家花園宅邸商店", "臺北市", "中和區", None, None), ("short", "新文昌祠", "臺北市", None, 25.0, 121.0), ("longer", "公民會館四四新村C館", "臺北市", None, 25.031, 121.562), ("tie", "北門郵局", "臺北市", None, None, None)]
    got = run(spark, sites, venues)
    assert got == brute(sites, venues)
    assert [(h, v) for h, v, *_ in got] == [("h1", "near"), ("h1", "status"), ("h2", "district"), ("h2", "inside"), ("h5", "longer")]
    reject, link = {("h7", "tie")}, [("h3", "far")]
    assert run(spark, sites, venues, reject, link) == brute(sites, venues, reject, link)


def test_random_rows_equal_a_loop(spark):
    """Few names and places, so that names are hot; every field is null at times."""
    pick = random.Random(4)
    some = lambda *x: pick.choice([*x, None])
    name = lambda: some("甲乙丙丁戊館", "甲乙丙丁", "丙丁戊館(甲乙丙丁)", "歷史建築甲乙丙丁", "國定古蹟丙丁戊館", "國立甲乙丙丁戊館二樓", "", "丙丁戊館（一級）")
    row = lambda k: (k, name(), some("A", "B"), some("x", "y"), *((some(24.0, 24.002, 24.008), 121.0) if pick.random() < 0.7 else (None, None)))
    fixed = lambda r: r if r[4] is not None else (*r[:4], None, None)
    heritages, venues = [fixed(row(f"h{k}")) for k in range(30)], [fixed(row(f"v{k}")) for k in range(300)]
    reject = {(f"h{pick.randrange(30)}", f"v{pick.randrange(300)}") for _ in range(400)}
    got = run(spark, heritages, venues, reject)
    assert got == brute(heritages, venues, reject) and len(got) > 20


def test_empty_tables(spark):
    assert run(spark, [], []) == []


def test_growing_sides_are_not_broadcast(spark):
    """Small tables here; at any size the rows of a join stay with the executors."""
    rows = spark.range(30).selectExpr("cast(id as string) as id", "concat('name ', id) as name", "'c' as city", "'d' as district", "24D as lat", "121D as lng")
    links = spark.range(30).selectExpr("cast(id as string) as heritage_id", "cast(id + 1 as string) as venue_id").where("heritage_id = '7'")
    found = containment.heritage_sites(rows, rows, links, links)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan
