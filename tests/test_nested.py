"""Payload functions over structs, arrays and maps, places among ties, and matching without ids."""

import random
from collections import Counter

from pyspark.sql import functions as F

from confluo.functions import nested, text
from confluo.operators import lifecycle, matching, ranking, state

PAYLOAD = "title string, phone string, email string, licenseNo string, imageUrl string, images array<string>, n int, sessions array<struct<note: string, links: struct<webUrl: string, memo: string>>>, extra map<string, string>"


def test_redaction_at_every_depth(spark):
    rows = [
        ("call 0912-345-678 now", "02-1、0912345678", "a@gmail.com", "x", "http://a/0912345678", ["0912345678"], 3, [{"note": " 0912345678", "links": {"webUrl": "u/0912345678", "memo": "0987654321 0912345678"}}, {"note": "", "links": {"webUrl": None, "memo": " "}}], {"memo": "b@gmail.com", "homeUrl": "0912345678"}),
        (None, None, None, None, None, [], None, None, {}),
    ]
    got = [r.asDict(recursive=True) for r in nested.redacted(spark.createDataFrame(rows, PAYLOAD)).collect()]
    assert got[0] == {
        "title": "call now", "phone": "02-1", "email": None, "imageUrl": "http://a/0912345678", "images": ["0912345678"], "n": 3,
        "sessions": [{"note": None, "links": {"webUrl": "u/0912345678", "memo": None}}], "extra": {"homeUrl": "0912345678"},
    }
    assert set(got[1].values()) == {None} and nested.redacted(spark.createDataFrame([], PAYLOAD)).count() == 0


def test_numbers_in_texts(spark):
    cases = {"0912345678": "", "第0912345678號": "第0912345678號", "a0912345678": "a0912345678", "x 0912345678 0987654321,0911222333 y": "x , y", "0909 0912345678": "0909", "+886-912 345 678。": "。", "109123456789": "109123456789", None: None}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, c string")
    assert [r.r for r in df.select("k", text.redact_text(F.col("c")).alias("r")).orderBy("k").collect()] == list(cases.values())


def test_canonical_values(spark):
    schema = "s string, n double, a array<int>, m struct<x: int, y: string>"
    df = spark.createDataFrame([(" A b", 1.5, [1, 2], (1, "Q")), (None, None, None, None)], schema)
    got = df.select(*(nested.canonical(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema.fields)).collect()
    assert tuple(got[0]) == ("ab", "1.5", "[1,2]", '{"x":1,"y":"Q"}') and tuple(got[1]) == ("", "", "", "")


def test_notability(spark):
    pick = random.Random(1)
    rows = [(k, pick.choice(["hot", "hot", "hot", "b", None]), pick.choice([None, 5, 5, 5, pick.randrange(40)]), pick.choice([None, 0, 1, 3])) for k in range(3000)] + [(9001, "alone", 7, 2)]
    got = {r.slug: r.score for r in ranking.notability(spark.createDataFrame(rows, "slug int, source string, popularity int, n_sources int").repartition(4)).collect()}
    by = {}
    for _, source, value, _ in rows:
        if source is not None and value is not None:
            by.setdefault(source, []).append(value)
    for slug, source, value, n in rows:
        own = sorted(by.get(source, []))
        place = (max(i for i, x in enumerate(own) if x <= value) / (len(own) - 1)) if source and value is not None and len(own) > 1 else 0
        assert abs(got[slug] - (max((n if n is not None else 1) - 1, 0) + place)) < 1e-9
    assert ranking.notability(spark.createDataFrame([], "slug int, source string, popularity int, n_sources int")).count() == 0


def test_strip_and_rematch_counts_every_pair(spark):
    """Weighted profiles count what pairing every two records would."""
    pick = random.Random(2)
    rows = []
    for k in range(160):
        kind = pick.choice(["event", "venue"])
        name = pick.choice(["abcdef", "abcdefgh", "zzzzzz"])
        rows.append((k, pick.choice(["a", "b", "c"]), kind, [name], 1, ["x"] if pick.random() < 0.7 else [], ["hall"] if pick.random() < 0.5 else [], 10, pick.choice([10, 20]), *pick.choice([(None, None), (24.0, 121.0), (24.002, 121.0)]), {"p": str(pick.randrange(6))} if pick.random() < 0.9 else None))
    schema = "id int, source string, kind string, variants array<string>, norm_name_count int, city array<string>, venue array<string>, start_day int, end_day int, lat double, lng double, external map<string, string>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in matching.strip_and_rematch(df).collect()}
    sides = [df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in "ab"]
    fields = [{c: F.col(f"{p}_{c}") for c in df.columns} | {"external": F.create_map().cast("map<string, string>")} for p in "ab"]
    every = sides[0].crossJoin(sides[1]).where("a_source < b_source and a_external['p'] = b_external['p']").select("a_source", "b_source", "a_kind", (F.col("a_variants")[0] == F.col("b_variants")[0]).alias("same"), matching.match_rule(*fields)["confidence"].alias("c"))
    want = Counter(), Counter(), Counter()
    for r in every.collect():
        for counter, yes in zip(want, (True, r.same, r.c is not None and r.c >= 0.8)):
            counter[tuple(r)[:3]] += bool(yes)
    assert got == {k: (want[0][k], want[1][k], want[2][k]) for k in want[0]} and sum(v[2] for v in got.values()) > 20


def test_first_write_and_saved_items(spark):
    registry = spark.createDataFrame([("a", 1, "old")], "key string, at int, value string")
    rows = spark.createDataFrame([("b", 5, "late"), ("b", 2, "first"), ("b", 2, "second"), ("a", 0, "new")], "key string, at int, value string").repartition(3)
    assert sorted(map(tuple, lifecycle.first_write_wins(registry, rows, "key", "at").collect())) == [("a", 1, "old"), ("b", 2, "first")]
    items = spark.createDataFrame([("event", f"s{k:03}", k % 7, None) for k in range(50)], "kind string, slug string, saved_at int, end_at int").repartition(5)
    got = state.saved_items(items, items.limit(0), F.lit(0), 12).orderBy("position").collect()
    want = sorted(((-(k % 7), f"s{k:03}") for k in range(50)))[:12]
    assert [(r.slug, r.position) for r in got] == [(s, i + 1) for i, (_, s) in enumerate(want)]
