"""Queries over whole tables: no row is left out by its id or place."""

import math
import os

import pytest

from confluo.plans import load_all
from confluo.plans.registry import QUERIES, table

DIR = "/root/testdata/sf0.001"
load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def metres(a, b):
    x, y = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(x / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(y / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


def test_same_place_by_brute_force(spark):
    rows = [(r["vec_id"], (24 + r["embedding"][0], 121 + r["embedding"][1])) for r in table(spark, DIR, "embeddings").collect()]
    assert max(i for i, _ in rows) >= 300
    keys = {}
    for row in rows:
        keys.setdefault(row[0] % 20, []).append(row)
    want = set()
    for own in keys.values():
        for i, a in own:
            for j, b in own:
                if i != j and ((i % 2 == j % 2 and metres(a, b) <= 20_000) if i % 3 and j % 3 else i % 7 == j % 7):
                    want.add((i, j))
    got = [(r["a_id"], r["b_id"]) for r in QUERIES["j07_same_place"](spark, DIR).collect()]
    assert len(got) == len(want) and set(got) == want


def test_every_point_and_order(spark):
    assert QUERIES["q27_map_points"](spark, DIR).count() == table(spark, DIR, "embeddings").count()
    assert max(r["slug"] for r in QUERIES["q13_editor_picks"](spark, DIR).collect()) >= 200
    top = max(r["c_custkey"] for r in table(spark, DIR, "customer").select("c_custkey").collect())
    assert max(r["slug"] for r in QUERIES["x16_saved_items"](spark, DIR).collect()) >= top - 2


def test_every_word_and_customer(spark):
    rows = table(spark, DIR, "conversations").collect()
    assert QUERIES["m10_unnest"](spark, DIR).count() == sum(len(r["text"].split(" ")) for r in rows if r["text"] is not None)
    rows = table(spark, DIR, "customer").collect()
    want = sorted(rows, key=lambda r: (r["c_nationkey"], -r["c_acctbal"], r["c_custkey"]))
    got = {r["place"]: r["c_custkey"] for r in QUERIES["t01_multi_key_sort"](spark, DIR).collect()}
    assert len(want) > 50 and [got[k + 1] for k in range(len(got))] == [r["c_custkey"] for r in want]
