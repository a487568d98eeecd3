"""Neighbours and venues around: the same as all pairs give, without making or sorting all pairs."""

import random

from pyspark.sql import functions as F

from confluo.functions import geo
from confluo.operators import discovery, spatial


def places(seed, crowd=150):
    """Points at one spot, a dense cluster, a thin plain, rows without a place, and repeated rows and ids."""
    pick = random.Random(seed)
    found = [(k, 24.0, 121.0) for k in range(crowd)] + [(200 + k, 24.005 + pick.random() / 2000, 121.0 + pick.random() / 2000) for k in range(100)]
    found += [(400 + k, 24.0 + pick.random() / 8, 121.0 + pick.random() / 8) for k in range(120)]
    found += [(600, None, 121.0), (601, float("nan"), 121.0), (602, 24.0, None), (3, 24.0, 121.0), (450, 24.0, 121.001), found[205], found[205]]
    return found


def frames(spark, found):
    df = spark.createDataFrame(found, "id long, lat double, lng double").repartition(3)
    return df.withColumnRenamed("id", "l_id"), df.withColumnRenamed("id", "r_id")


def nearest(left, right, metres, k):
    for l_id in {x[0] for x in left}:
        near = []
        for x in left:
            for y in right:
                if x[0] == l_id != y[0] and None not in x + y and (m := geo.metres(x[1], x[2], y[1], y[2])) <= metres:
                    near.append((round(m, 6), y[0]))
        yield from ((l_id, r_id, rank + 1) for rank, (_, r_id) in enumerate(sorted(near)[:k]))


def test_nearest_k_is_that_of_all_pairs(spark):
    found = places(1, 40)
    left, right = frames(spark, found)
    got = sorted(map(tuple, spatial.nearest_k(left, right, 2000, 4).select("l_id", "r_id", "rank").collect()))
    assert got == sorted(nearest(found, found, 2000, 4)) and len(got) > 800
    none = frames(spark, [])[1]
    assert spatial.nearest_k(left, none, 2000, 4).count() == 0


def test_nearest_k_does_not_meet_all_pairs_of_a_spot(spark, monkeypatch):
    met, metres = spark.sparkContext.accumulator(0), geo.haversine_m
    count = F.udf(lambda x: met.add(1) or 0.0, "double").asNondeterministic()
    monkeypatch.setattr(geo, "haversine_m", lambda a, b, c, d: metres(a, b, c, d) + count(a))
    found = [(k, 24.0, 121.0) for k in range(300)] + [(1000 + k, 24.0 + k / 1e5, 121.0) for k in range(300)]
    assert spatial.nearest_k(*frames(spark, found), 2000, 4).count() == 4 * len(found)
    assert met.value < 60 * len(found)


def test_venues_around_are_those_of_all_pairs(spark):
    found = places(2)
    left, right = frames(spark, found)
    venues = right.dropDuplicates(["r_id"]).withColumnRenamed("r_id", "id").selectExpr("*", "if(id % 7 > 0, id % 7, null) as building", "id % 5 as events", "concat('n', id % 3, '-', id) as name").localCheckpoint()
    pairs = spatial.radius_join(left, venues.withColumnRenamed("id", "r_id"), 2000).where("l_id <> r_id")
    want = sorted(map(tuple, discovery.nearby_venues(pairs, venues).collect()))
    found = discovery.venues_around(left, venues, 2000)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Window") >= 1
