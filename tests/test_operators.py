import datetime as dt

import pytest
from pyspark.sql import functions as F

from confluo.functions import text
from confluo.operators import calendar, fusion, graph, lifecycle, matching, ranking, relations, spatial, state


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def record(**kw):
    base = {"id": 0, "source": "s1", "kind": "event", "title": "", "external": {}, "city": ["臺北市"], "venue": [], "start": "2026-01-01", "end": "2026-01-02", "lat": None, "lng": None, "count": 1}
    return base | kw


KIND = "id int, source string, kind string, title string, external map<string,string>, city array<string>, venue array<string>, start string, end string, lat double, lng double, count int"


def rule_of(spark, a, b, forced=None, blocked=None):
    df = spark.createDataFrame([record(**a), record(**b)], KIND).withColumn("variants", text.title_variants(F.col("title"))).collect()
    kind = KIND + ", variants array<string>"
    x = spark.createDataFrame([df[0]], kind).select(F.struct("*").alias("x"))
    y = spark.createDataFrame([df[1]], kind).select(F.struct("*").alias("y"))
    side = lambda n: {k: F.col(f"{n}.{v}") for k, v in {"source": "source", "kind": "kind", "external": "external", "variants": "variants", "norm_name_count": "count", "city": "city", "venue": "venue", "start_day": "start", "end_day": "end", "lat": "lat", "lng": "lng"}.items()}
    r = x.crossJoin(y).select(matching.match_rule(side("x"), side("y"), None if forced is None else F.lit(forced), None if blocked is None else F.lit(blocked)).alias("m")).first()["m"]
    return None if r is None else (r["rule"], r["confidence"])


def test_match_ladder(spark):
    t = {"title": "古典音樂之夜"}
    o = {"source": "s2", **t}
    assert rule_of(spark, t, o, blocked=True) is None
    assert rule_of(spark, t, {"title": "完全不同的東西", "source": "s2"}, forced=True) == ("manual", 1.0)
    assert rule_of(spark, t | {"external": {"a": "1"}}, o | {"external": {"a": "2"}}) is None
    assert rule_of(spark, t | {"external": {"a": "1"}}, {"title": "x", "external": {"a": "1"}}) == ("external-id", 1.0)
    assert rule_of(spark, t | {"kind": "venue", "external": {"a": "1"}}, o | {"external": {"a": "1"}}) == ("external-id", 1.0)
    assert rule_of(spark, t | {"venue": ["館"]}, o | {"venue": ["館"], "city": []}) == ("title+date+venue", 0.9)
    assert rule_of(spark, t | {"venue": ["館"]}, o | {"venue": ["大館"]}) == ("title+date+city", 0.6)
    assert rule_of(spark, t | {"kind": "venue"}, o) is None
    assert rule_of(spark, t | {"kind": "person"}, o | {"kind": "person"}) is None
    assert rule_of(spark, t, {"title": "完全不同的東西"}) is None
    assert rule_of(spark, t, o | {"start": "2026-03-01", "end": "2026-03-02"}) is None
    assert rule_of(spark, t | {"venue": ["國家音樂廳"]}, o | {"venue": ["國家音樂廳演奏廳"]}) == ("title+date+venue", 0.9)
    assert rule_of(spark, t | {"lat": 25.0, "lng": 121.5}, o | {"lat": 25.001, "lng": 121.5}) == ("title+date+geo", 0.85)
    assert rule_of(spark, t, o) == ("title+date+city", 0.6)
    assert rule_of(spark, t, o | {"city": ["高雄市"]}) == ("title-only", 0.3)
    longer = {"title": "春季古典音樂之夜特輯"}
    assert rule_of(spark, t, longer) == ("title~/same-source-subevent", 0.3)
    assert rule_of(spark, t | {"venue": ["大劇院"]}, longer | {"source": "s2", "venue": ["大劇院"]}) == ("title~+date+venue", 0.85)
    v = {"kind": "venue"}
    assert rule_of(spark, t | v, longer | v) is None
    here = {"lat": 25.0, "lng": 121.5}
    assert rule_of(spark, t | v | here, o | v | here) == ("name+geo", 0.85)
    assert rule_of(spark, t | v | here | {"count": 2}, t | v | here) == ("name+geo/dup-row", 0.85)
    assert rule_of(spark, t | v | here | {"count": 3}, t | v | here) == ("name+geo/shared-label", 0.3)
    assert rule_of(spark, t | v | here, o | v | {"lat": 25.1, "lng": 121.5}) == ("name+far-geo", 0.3)
    assert rule_of(spark, t | v, o | v | {"city": ["高雄市"]}) == ("name-only", 0.3)
    assert rule_of(spark, t | v, t | v) == ("name+city/same-source", 0.4)
    assert rule_of(spark, t | v, o | v) == ("name+city/cross-source", 0.8)


def test_block_keys(spark):
    df = spark.createDataFrame([("event", "【A】音樂會之夜", {"opentix": "9"}), ("person", "王小明", None), ("venue", "小館", None)], "kind string, title string, external map<string,string>")
    found = [set(r["k"]) for r in df.select(matching.block_keys(F.col("title"), F.col("kind"), F.col("external")).alias("k")).collect()]
    assert found == [{"t:音樂會之夜", "t:a音樂會之夜", "p:音樂會之", "p:a音樂會", "x:opentix:9"}, set(), {"t:小館"}]


def test_graph(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a int, b int")
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 41), 100, 101, 200]], "id int")
    cc = graph.connected_components(nodes, edges)
    assert {r["component"] for r in cc.collect()} == {1, 100, 200}
    out = {r["id"]: (r["component"], r["forced"]) for r in graph.eject_blocked(cc, spark.createDataFrame([(101, 100), (1, 2)], "a int, b int")).collect()}
    assert out[101] == (101, True) and out[2] == (2, True) and out[3] == (1, False)
    assert dict(rows(graph.follow(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")))) == {"a": "d", "b": "d", "c": "d", "x": "y"}


def test_stable_ids_and_slugs(spark):
    members = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 3, False), (4, 4, False)], "id int, component int, forced boolean")
    previous = spark.createDataFrame([(1, "A"), (3, "A"), (2, "B")], "id int, stable_id string")
    assert rows(graph.inherit_ids(members, previous)) == [(1, "A"), (3, "3"), (4, "4")]
    registry = spark.createDataFrame([(1, "v", "x"), (9, "v", "y-3")], "id int, kind string, slug string")
    wanted = spark.createDataFrame([(1, "v", "x"), (2, "v", "x"), (3, "v", "x"), (4, "v", "y"), (5, "e", "x")], "id int, kind string, wanted string")
    assert rows(graph.assign_slugs(wanted, registry)) == [(1, "v", "x"), (2, "v", "x-2"), (3, "v", "x-3"), (4, "v", "y-4"), (5, "e", "x")]


def test_two_runs_write_nothing_new(spark):
    day = lambda d: F.lit(d).cast("date")
    snapshot = spark.createDataFrame([("a", "h1", "p1"), ("b", "h2", "p2")], "id string, content_hash string, payload string")
    empty = spark.createDataFrame([], "id string, content_hash string, payload string, first_observed_at date, last_verified_at date, last_changed_at date, disappeared_at date")
    first = lifecycle.scd_merge(empty, snapshot, "id", day("2026-01-01"))
    assert {r["status"] for r in first.collect()} == {"added"}
    second = lifecycle.scd_merge(first.drop("status"), snapshot.where("id = 'a'"), "id", day("2026-01-02"))
    got = {r["id"]: r for r in second.collect()}
    assert got["a"]["status"] == "same" and got["a"]["last_changed_at"] == dt.date(2026, 1, 1) and got["a"]["last_verified_at"] == dt.date(2026, 1, 2)
    assert got["b"]["status"] == "gone" and got["b"]["disappeared_at"] == dt.date(2026, 1, 2)
    third = {r["id"]: r for r in lifecycle.scd_merge(second.drop("status"), snapshot, "id", day("2026-01-03")).collect()}
    assert third["b"]["disappeared_at"] is None and third["b"]["status"] == "same"
    write, delete = lifecycle.changes(snapshot, snapshot, "id")
    assert write.count() == 0 and delete.count() == 0


def test_recycled_ids(spark):
    log = spark.createDataFrame([("s:1", "2026澎湖跳島101K自行車活動"), ("s:2", "音樂會")], "id string, title string")
    now = spark.createDataFrame([("s:1", 0, "澎湖大行軍"), ("s:2", 1, "2026音樂會"), ("s:3", 2, "新的")], "base string, seq int, title string")
    assert rows(lifecycle.recycled_ids(log, now)) == [("s:1", 0, "s:1~2"), ("s:2", 1, "s:2"), ("s:3", 2, "s:3")]


def test_stable_content_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, seq int")
    legacy = spark.createDataFrame([("a#2", "old7")], "key string, id string")
    found = {r["seq"]: r["record_id"] for r in lifecycle.stable_ids(df, F.col("name"), "seq", legacy).collect()}
    assert found[2] == "old7" and found[1].startswith("k") and len(found[1]) == 13 and len(set(found.values())) == 3


def test_fusion(spark):
    kind = "entity int, field string, value string, base double, fresh double, ordinal int, source string"
    df = spark.createDataFrame([(1, "f", "A b", 0.5, 1.0, 0, "x"), (1, "f", "ab", 0.5, 1.0, 1, "y"), (1, "f", "other", 0.58, 1.0, 2, "z"), (1, "f", "never", 0.0, 1.0, 3, "z"), (2, "f", "12", 0.5, 1.0, 0, "x"), (2, "f", "99", 0.5, 1.0, 1, "y")], kind)
    got = {r["entity"]: r for r in fusion.fused(df).collect()}
    assert got[1]["value"] == "A b" and got[1]["score"] == 0.6 and got[1]["rejected"] == ["other"]
    assert got[2]["value"] == "99"
    assert rows(fusion.conflicts(df)) == [(1, 1), (2, 1)]
    members = spark.createDataFrame([(1, "s", "2026-01-01", "2026-02-01"), (1, "s", None, "2026-02-01"), (2, "s", "2026-01-01", "2026-02-01")], "cluster int, source string, disappeared_at string, last_day string")
    assert fusion.without_superseded(members).count() == 2
    sessions = spark.createDataFrame([(1, "s", "a", True), (1, "s", "b", False), (2, "s", "a", True)], "cluster int, source string, session_key string, cancelled boolean")
    assert rows(fusion.without_cancelled(sessions)) == [(1, "s", "b", False), (2, "s", "a", True)]


def test_hysteresis(spark):
    today = F.lit("2026-01-10").cast("date")
    kind = "path string, indexable boolean, qualified_since date, gated boolean"
    d = lambda n: dt.date(2026, 1, n)
    old = spark.createDataFrame([("in-low", True, d(1), False), ("in-drop", True, d(1), False), ("out-new", False, None, False), ("out-two", False, d(8), False), ("gated", False, d(1), True)], kind)
    scores = spark.createDataFrame([("in-low", 3.0), ("in-drop", 2.5), ("out-new", 5.0), ("out-two", 5.0), ("gated", 3.5), ("page-new", 5.0), ("page-low", 4.9)], "path string, score double")
    got = {r["path"]: (r["indexable"], r["qualified_since"]) for r in state.hysteresis(scores, old, today).collect()}
    assert got == {"in-low": (True, None), "in-drop": (False, None), "out-new": (False, d(10)), "out-two": (True, d(8)), "gated": (True, None), "page-new": (True, d(10)), "page-low": (False, None)}
    gate = state.hysteresis(scores, old, today, F.col("path") == "out-two")
    assert {r["path"]: (r["indexable"], r["gated"]) for r in gate.collect()}["out-two"] == (False, True)
    first = state.hysteresis(scores, old.limit(0), today)
    assert {r["path"] for r in first.where("indexable").collect()} == {"out-new", "out-two", "page-new"}


def test_scores(spark):
    df = spark.createDataFrame([("六個字的標題", "v", "d", "c", "x", 25.0, "street", "cat", 2, 2, 1, "2020-01-01", 0, False)], "title string, venue string, description string, city string, district string, lat double, precision string, category string, sessions int, sources int, images int, end string, impressions int, thin boolean")
    c = {k: F.col(k) for k in df.columns}
    late = F.lit("2026-01-01").cast("date")
    assert df.select(state.event_score(c, late)).first()[0] == 10 - 4
    assert df.select(state.event_score(c, F.lit("2020-01-20").cast("date"))).first()[0] == 10
    v = spark.createDataFrame([(20, 1.0, "street", "c", "d", True, "h")], "events int, lat double, precision string, city string, description string, registry boolean, hours string")
    assert v.select(state.venue_score({k: F.col(k) for k in v.columns})).first()[0] == 10


def test_capped_lists_same_as_plain_loop(spark):
    import random

    rng = random.Random(1)
    data = [(g, i, rng.randrange(4), rng.randrange(5)) for g in range(3) for i in range(60)]
    got = rows(ranking.capped(spark.createDataFrame(data, "g int, i int, a int, b int"), "g", "i", "a", "b", 2, 7))
    want = []
    for g in range(3):
        seen, n = {}, 0
        for r in data:
            if r[0] == g and n < 7 and seen.get(("a", r[2]), 0) < 2 and seen.get(("b", r[3]), 0) < 2:
                seen["a", r[2]], seen["b", r[3]] = seen.get(("a", r[2]), 0) + 1, seen.get(("b", r[3]), 0) + 1
                n += 1
                want.append(r)
    assert got == sorted(want, key=str)


def test_relations(spark):
    names = spark.createDataFrame([("國家音樂廳演奏廳", "國家音樂廳演奏廳", "臺北市"), ("別的", "別的", None)], "name string, key string, city string")
    registry = spark.createDataFrame([("國家音樂廳", 1, "臺北市"), ("音樂廳演", 2, "高雄市")], "key string, id int, city string")
    assert rows(relations.unique_contained(names, registry)) == [("國家音樂廳演奏廳", 1)]
    hall = spark.createDataFrame([("x", "臺灣戲曲中心大表演廳")], "name string, key string")
    assert rows(relations.by_suffix(hall, spark.createDataFrame([("大表演廳", 7), ("中心大表演廳", 8)], "key string, id int"))) == [("x", 8)]
    cand = spark.createDataFrame([("h1", "v1", 0, 5), ("h1", "v2", 0, 5), ("h2", "v1", 1, 6), ("h3", "v1", 0, 4)], "left string, right string, rank int, size int")
    assert rows(relations.one_to_one(cand)) == [("h3", "v1")]


def test_spatial(spark):
    pts = spark.createDataFrame([(1, 25.0, 121.5), (2, 25.0008, 121.5), (3, 25.0016, 121.5), (4, 25.1, 121.5), (5, None, None)], "id int, lat double, lng double")
    assert rows(spatial.single_link(pts, 100)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    names = spark.createDataFrame([(["文化中心大廳", "文化中心小廳"],), (["甲館", "乙館二樓"],)], "n array<string>")
    assert [r[0] for r in names.select(spatial.building_name(F.col("n"))).collect()] == ["文化中心", "甲館"]


def test_calendar(spark):
    df = spark.createDataFrame([("2026 音樂節第3屆",), ("音樂節",), ("2026",)], "t string")
    assert [r[0] for r in df.select(calendar.series_key(F.col("t"))).collect()] == [None, None, None]
    df = spark.createDataFrame([("2026 臺北國際音樂節 第3屆",)], "t string")
    assert df.select(calendar.series_key(F.col("t"))).first()[0] == "臺北國際音樂節"


def test_ids_follow_the_first_member(spark):
    kind = "id int, component int, forced boolean"
    members = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 3, False), (4, 3, False)], kind)
    previous = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Y")], "id int, stable_id string")
    assert rows(graph.inherit_ids(members, previous)) == [(1, "X"), (3, "Y")]
    # 5 and 5-2 are in use, so the new component counts on
    members = spark.createDataFrame([(1, 1, False), (2, 2, False), (5, 5, False)], kind)
    previous = spark.createDataFrame([(1, "5"), (2, "5-2")], "id int, stable_id string")
    assert rows(graph.inherit_ids(members, previous)) == [(1, "5"), (2, "5-2"), (5, "5-3")]
    # a number of an old id that nobody holds now is free
    assert rows(graph.inherit_ids(members.where("id <> 2"), previous)) == [(1, "5"), (5, "5-2")]


def test_health(spark):
    kind = "source string, live int, gone int, first_days int, changed_days int, rolling int, fetched int"
    data = [("ok", 9, 1, 10, 0, None, None), ("warn", 7, 3, 10, 0, None, None), ("fail", 4, 6, 200, 100, None, None), ("stale", 9, 0, 200, 90, None, None), ("young", 9, 0, 80, 80, None, None), ("empty", 0, 0, 0, 0, None, None)]
    data += [("rolls", 1, 99, 200, 200, 50, 50), ("few", 50, 0, 9, 0, 50, 24), ("fewer", 50, 0, 9, 0, 50, 39), ("unknown", 50, 0, 9, 0, 50, None)]
    got = {r["source"]: (r["verdict"], r["problems"]) for r in state.health(spark.createDataFrame(data, kind)).collect()}
    assert got["ok"] == got["young"] == got["rolls"] == ("ok", []) and got["warn"] == ("warn", ["warn:shrunk"]) and got["fail"] == ("fail", ["fail:shrunk", "warn:stale"])
    assert got["stale"] == ("warn", ["warn:stale"]) and got["empty"] == ("fail", ["fail:empty"]) and got["few"][0] == "fail" and got["fewer"][0] == got["unknown"][0] == "warn"


def test_frequencies(spark):
    cases = {"不定期更新（每年）": "irregular", "": "undeclared", None: "undeclared", "每季": "monthly", "半年": "monthly", "每1日": "daily", "每天": "daily", "每3月": "monthly", "每年": "yearly", "annually": "yearly", "UNVERIFIED: 每日": "undeclared", "每週": "undeclared"}
    found = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", state.freq_bucket(F.col("c")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in found] == list(cases.values())


def test_city_months_are_local(spark):
    at = lambda s: int(dt.datetime.fromisoformat(s).timestamp())
    today = at("2026-07-15T00:00:00+08:00")
    data = [(k, "a", at("2026-08-01T03:00:00+08:00"), None) for k in range(5)] + [(9, "a", at("2026-01-01T10:00:00+08:00"), at("2026-08-02T00:00:00+08:00")), (10, "a", at("2026-06-30T23:00:00+08:00"), None), (11, None, today, None)]
    df = spark.createDataFrame(data, "slug int, city string, start long, end long")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Taipei"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = rows(calendar.city_months(df, today, "2026-06-01").selectExpr("city", "cast(month as string)", "events", "ongoing", "past"))
            assert got == [("a", "2026-06-01", 1, 0, True), ("a", "2026-08-01", 5, 1, False)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("at_once", [64, 3])
def test_nearby_events_same_as_plain_loop(spark, monkeypatch, at_once):
    import random

    from confluo.operators import discovery

    monkeypatch.setattr(discovery, "CITY_ROWS", at_once)
    rng = random.Random(3)
    data = [(rng.randrange(260), rng.choice([None, *range(9)]), rng.choice("ab"), rng.choice([None, *range(6)]), rng.randrange(100), rng.choice([None, 100, 200])) for _ in range(320)] + [(1000 + k, 50, "c", 7, 60 + k, None) for k in range(90)] + [(2000, 51, "c", 8, 400, None)]
    kind = "slug int, venue int, city string, series int, start int, end int"
    df = spark.createDataFrame(data, kind)
    pages = [(k, k % 9, "ab"[k % 2], k) for k in range(40)] + [(1000, 50, "c", 1000), (3000, None, "c", 3000)]
    got = {}
    for r in discovery.nearby_events(spark.createDataFrame(pages, "page int, venue int, city string, slug int"), df, 50).collect():
        got.setdefault(r["page"], []).append((r["place"], r["slug"], r["tier"]))
    live = sorted((r for r in data if (r[5] if r[5] is not None else r[4]) >= 50), key=lambda r: (r[4] < 50, r[4] if r[4] >= 50 else r[5], r[0]))
    for page, venue, city, slug in pages:
        out, seen, held = [], {slug}, {}
        for tier, match in ((0, lambda r: venue is not None and r[1] == venue), (1, lambda r: r[2] == city)):
            for r in live:
                if len(out) < 6 and match(r) and r[0] not in seen:
                    keys = [("v", r[1]), ("s", r[3])]
                    if tier and any(held.get(k, 0) >= 2 for k in keys if k[1] is not None):
                        continue
                    seen.add(r[0])
                    for k in keys:
                        held[k] = held.get(k, 0) + 1
                    out.append((r[0], tier))
        assert [(s, t) for _, s, t in sorted(got.get(page, []))] == out, page


def test_costly_expressions_are_worked_out_once_for_each_value(spark):
    made = spark.sparkContext.accumulator(0)
    shown = F.udf(lambda a, b: made.add(1) or f"{a}/{b}", "string")
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, id % 3) as a", "cast(id % 2 as string) as b")
    got = lifecycle.per_value(rows, ["a", "b"], shown("a", "b"), "shown").collect()
    assert sorted(map(tuple, got)) == [(i, i % 3 or None, str(i % 2), f"{i % 3 or None}/{i % 2}") for i in range(2000)]
    assert made.value <= 2 * 6


def test_contained_takes_each_key_apart_once(spark):
    names = spark.range(300).selectExpr("id as name", "concat('red hall ', id % 5) as key", "if(id % 2 = 0, 'a', null) as city")
    registry = spark.createDataFrame([(1, "hall", None), (2, "red hall", "a"), (3, "red hall", "b"), (4, "red", None)], "id int, key string, city string")
    found = relations.contained(names, registry)
    assert found.count() == 150 * 2 + 150 * 3 and set(found.where("name = 0").toPandas()["id"]) == {1, 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :].split("LocalRelation")[0].split("Range")[0]
