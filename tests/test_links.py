"""Sparse links and weighed pairs against all pairs."""

import itertools
import random

from pyspark.sql import functions as F

from confluo.operators import graph, matching


def parts(spark, n=160):
    draw = random.Random(3)
    rows = [(i, draw.choice("xyz"), draw.choice("pqrstuv"), round(draw.uniform(0, 120), 1)) for i in range(n)]
    rows += [(n, "x", "p", None), (n + 1, "x", None, 3.0), (n + 2, None, "p", 3.0), (n + 3, "x", None, 4.0), (n + 4, "y", "q", float("nan")), (n + 5, "w", "p", 1.0), (n + 6, "w", "p", 21.0), (n + 7, "v", "p", None), (n + 8, "v", "p", None)]
    return rows, spark.createDataFrame(rows, "id long, key string, brand string, price double")


def groups(pairs):
    """The components of pairs, in Python."""
    label = {}
    for a, b in pairs:
        one, two = label.setdefault(a, {a}), label.setdefault(b, {b})
        if one is not two:
            one |= two
            label.update(dict.fromkeys(two, one))
    return {frozenset(g) for g in label.values()}


def pairs_of(rows, rule):
    known = lambda v: v is not None and v == v
    for a, b in itertools.combinations(rows, 2):
        near = known(a[3]) and known(b[3]) and abs(a[3] - b[3]) <= 7
        if a[1] is not None and a[1] == b[1] and rule(a[2] is not None and a[2] == b[2], near):
            yield a[0], b[0]


def found(links):
    return groups((r.a, r.b) for r in links.collect())


def test_links_connect_what_all_pairs_connect(spark):
    rows, table = parts(spark)
    assert found(graph.near_links(table, ["key", "brand"], "price", 7)) == groups(pairs_of(rows, lambda like, near: like and near))
    assert found(graph.far_links(table, ["key", "brand"], "price", 7)) == groups(pairs_of(rows, lambda like, near: like and not near))
    assert found(graph.unlike_near_links(table, ["key"], "price", 7, "brand")) == groups(pairs_of(rows, lambda like, near: not like and near))


def test_links_do_not_grow_with_the_square(spark):
    table = spark.range(400).selectExpr("id", "'x' as key", "concat('b', id % 2) as brand", "double(id % 30) as price")
    for links in (graph.near_links(table, ["key"], "price", 7), graph.far_links(table, ["key"], "price", 7), graph.unlike_near_links(table, ["key"], "price", 7, "brand")):
        assert links.count() <= 800


def test_weighed_pairs_count_all_pairs(spark):
    rows, table = parts(spark)
    copies = table.where("key is not null and brand is not null").withColumn("id", F.explode(F.array(F.col("id"), F.col("id") + 1000)))
    pairs = matching.weighed_pairs(copies, ["key", "brand"], "price")
    quality = matching.pair_quality(pairs.where("abs(a - b) <= 7"), pairs, ["key", "brand"]).first()
    plain = [(r.id, r.key, r.brand, r.price) for r in copies.collect()]
    assert quality.true_pairs == len(list(pairs_of(plain, lambda like, near: like)))
    assert quality.found == quality.correct == len(list(pairs_of(plain, lambda like, near: like and near)))
    assert pairs.count() < quality.true_pairs / 2


def test_blocked_pairs_arise_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "CELL_ROWS", 3)
    draw = random.Random(5)
    rows = [(i, draw.sample("pqrst", draw.randrange(4)) + ([None] if i % 5 == 0 else []), i % 3) for i in range(60)]
    table = spark.createDataFrame([*rows, rows[7], (8, ["q", "q"], 8 % 3)], "id long, keys array<string>, c int")
    keys = {i: set(k) - {None} for i, k, _ in rows}
    keys[8] |= {"q"}
    pairs = matching.blocked_pairs(table, "id", "keys", "c")
    want = sorted((a, b, a % 3, b % 3) for a, b in itertools.combinations(range(60), 2) if keys[a] & keys[b])
    assert sorted(tuple(r) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project") and "Join" in plan.splitlines()[1]


def test_components_of_a_long_chain(spark):
    """Rounds do not grow with the length of a chain, in whatever order its ids stand."""
    ids = list(range(400))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (1000, 1001), (1001, 1001)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*ids, 1000, 1001, 2000]], "id long")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert got == dict.fromkeys(ids, 0) | {1000: 1000, 1001: 1000, 2000: 2000}


def test_rows_of_a_frequent_key_are_shuffled_a_few_times(spark, monkeypatch):
    """Rows meet in a grid of cells; the number of cells, and with it what is shuffled, does not grow with a key's rows."""
    rows = spark.range(9000).selectExpr("id", "array('hot') as keys")
    met = matching.blocked_pairs(rows, "id", "keys").where("a >= 8990")
    assert len(met.collect()) == 45
    assert 9000 <= max(rows_sent(met)) <= 2 * 9000
    monkeypatch.setattr(matching, "CELL_ROWS", 10)
    monkeypatch.setattr(matching, "CELLS", 4)
    met = matching.blocked_pairs(rows.where("id < 300"), "id", "keys")
    assert {(r["a"], r["b"]) for r in met.collect()} == {(a, b) for b in range(300) for a in range(b)}
    assert max(rows_sent(met)) == 4 * 300


def rows_sent(df):
    """How many rows each shuffle of a query that has run has written."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found
