"""Pairs of rows with many copies: what is compared are distinct values, and the rows are those of all pairs."""

import hashlib
import itertools
import math
import random

import pyarrow as pa

from __spark_entry__ import queries
from confluo.operators import recommend, search, spatial
from confluo.plans import recommend_queries


def test_title_dice_of_copies(spark, tmp_path):
    names = ["old brass ring", "Old brass-ring", "new brass ring", "hot bolt", "cold bolt", "hot volt"]
    parts = [(i, names[i % 6], "b%d" % (i % 7 % 2), "t") for i in range(90)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = queries()["m05_title_dice"](spark, str(tmp_path))
    want = {}
    for (a, n, brand, _), (b, m, other, _) in itertools.combinations(parts, 2):
        one, two = ({s[i : i + 2] for i in range(len(s) - 1)} for s in ("".join(c for c in x.lower() if c.isalnum()) for x in (n, m)))
        dice = round(2 * len(one & two) / (len(one) + len(two)), 6)
        if brand == other and dice >= 0.5:
            want[a, b] = dice
    found = got.collect()
    assert {(r["a"], r["b"]): r["dice"] for r in found} == want and len(found) == len(want)
    compared = got._jdf.queryExecution().optimizedPlan().toString().split("array_intersect", 1)[1]
    assert "Aggregate [p_brand" in compared, "names are compared once for each brand and type, not once for each pair of parts"


def test_rules_are_made_once_for_each_pair(spark, tmp_path):
    parts = [(i, "n%d" % (i % 3), "b%d" % (i % 2), "steel" if i % 4 else "tin", i % 3) for i in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = queries()["j02_rules"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("name+far-geo") == 1
    pairs = {(r["a"], r["b"]) for r in got.collect()}
    agree = {(a[0], b[0]) for a, b in itertools.combinations(parts, 2) if a[3:] == b[3:]}
    late = {(a, b) for a, b in agree if parts[a][4] % 2 == 0 and abs(a % 10 - b % 10) > 4}  # events that do not meet in time
    assert pairs == agree - late


def test_long_queries_are_looked_up_under_long_substrings(spark, tmp_path):
    """Texts of a few syllables share their bigrams; a query of a whole text meets that text and not all others."""
    texts = ["".join(p) for p in itertools.permutations(["ba", "de", "fi", "go", "ku"])]
    rows = spark.createDataFrame([(i, t, "", "", "", i, None) for i, t in enumerate(texts)], "slug long, title string, venue string, city string, cat string, start long, end long")
    index = search.Index.build(rows, f"{tmp_path}/index", 0)
    asked = spark.createDataFrame([(t,) for t in [*texts, "a", "ba", "ade", "adefi", "xx"]], "needle string")
    want = {(n, t) for n in [*texts, "a", "ba", "ade", "adefi"] for t in texts if n in t}
    assert {(r["needle"], r["hay"]) for r in index.holding(asked).collect()} == want
    long = asked.where("length(needle) = 10")
    assert index.candidates(long).count() <= 2 * len(texts)


def test_seen_items_are_not_broadcast(spark, tmp_path):
    """Arrays that a projection makes of a number are far larger than Spark's estimate of them."""
    path = f"{tmp_path}/people"
    spark.range(1000).selectExpr("id as person").write.parquet(path)
    people = spark.read.parquet(path).selectExpr("person", "transform(sequence(0L, 399L), k -> k * 3 + person % 3) as seen")
    lists = spark.range(1000).selectExpr("id as person", "inline(array(struct(id % 5 as slug, 1 as rank), struct(id % 5 + 1 as slug, 2 as rank)))")
    got = recommend.picked(lists, people, 7)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("slug >= 0").count() == 1000


def test_exploded_levels_are_not_broadcast(spark, tmp_path):
    places = spark.range(300).selectExpr("id as r_id", "23 + id % 17 * 0.01 as lat", "121 + id % 13 * 0.01 as lng", "id % 2 as list")
    seekers = spark.range(50).selectExpr("id as l_id", "23.05 + id * 0.001 as lat", "121.05 as lng", "id % 2 as list")
    got = spatial.nearest_in_rings(seekers, places, 3, ["list"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    assert got.count() == 150


def test_rows_met_around_a_place_are_not_sorted(spark):
    """Each seeker meets hundreds of rows and keeps three: what the last sort and its shuffle get are a few for each."""
    right = spark.range(20_000).selectExpr("id as r_id", "23 + (id * 7919) % 10007 * 0.0001d as lat", "121 + (id * 6101) % 9973 * 0.0001d as lng", "0 as list")
    seekers = spark.range(60).selectExpr("id as l_id", "23 + (id * 3571) % 9901 * 0.0001d as lat", "121 + (id * 2797) % 9887 * 0.0001d as lng", "0 as list")
    got = spatial.nearest_in_rings(seekers, right, 3, ["list"])
    found = {(r["l_id"], r["rank"]): r["r_id"] for r in got.collect()}

    def metres(p, q):
        (a, b), (c, d) = (map(math.radians, x) for x in (p, q))
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    places = right.collect()
    for s in seekers.collect():
        near = sorted((metres((s["lat"], s["lng"]), (p["lat"], p["lng"])), p["r_id"]) for p in places)[:3]
        assert [found[s["l_id"], k] for k in (1, 2, 3)] == [r for _, r in near]
    plan = got._jdf.queryExecution().executedPlan().toString()
    window, rest = plan.split("Window", 1)[1].split("SortMergeJoin", 1)[0], "MapInArrow"
    assert rest in window, "rows are reduced between the join and the window"


def test_closest_rows_of_each_run():
    rng = random.Random(5)
    rows = [(l, r, float(rng.randrange(9))) for l in [1, 2, 3, 2, None, 4] for r in range(rng.randrange(1, 60))]
    table = pa.table({"l_id": [r[0] for r in rows], "r_id": [r[1] for r in rows], "metres": [r[2] for r in rows]})
    out = [tuple(x.values()) for size in (1, 7, 1000) for b in spatial._closest(5)(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
    runs = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r[0])]
    want = [x for g in runs for x in g if x[2] <= sorted(y[2] for y in g)[:5][-1]]
    assert out == want * 3


def test_seen_items_that_follow_from_a_number_are_not_shuffled(spark, monkeypatch):
    """Arrays of 400 items for each person are far more than the lists; they are made behind the join."""
    given = {}
    monkeypatch.setattr(recommend_queries, "_nearest", lambda s, d: (s.range(50).selectExpr("id as person", "id % 7 as seen"), s.range(50).selectExpr("id as person", "inline(array(struct(id as slug, 1 as rank), struct(id + 1 as slug, 2 as rank)))")))
    got = recommend_queries.pick(spark, "")
    for r in got.collect():
        given[r["person"]] = r["slug"]
    for person in range(50):
        seen = {k * 3 + person % 7 % 3 for k in range(400)}
        fresh = [x for x in (person, person + 1) if x not in seen] or [person, person + 1]
        assert given[person] == min(fresh, key=lambda x: hashlib.md5(f"{recommend_queries.SEED}|{person}|{x}".encode()).hexdigest())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "transform" in above and "transform" not in below
