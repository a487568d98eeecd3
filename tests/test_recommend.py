"""Spans, availability, lists, nearest items, picks and heritage pages against plain loops."""

import datetime
import hashlib
import math
import random

from pyspark.sql import functions as F

from confluo.operators import discovery, recommend, spatial

ZONE = datetime.timezone(datetime.timedelta(hours=8))
HOUR, DAY = 3600, 86_400


def seconds(*ymdh):
    return int(datetime.datetime(*ymdh, tzinfo=ZONE).timestamp())


def test_spans():
    by = lambda now: {s.name: (s.start, s.end, s.night) for s in recommend.spans(now)}
    wednesday, sunday, night = seconds(2024, 3, 6, 10), seconds(2024, 3, 10, 15), seconds(2024, 3, 9, 22)
    assert by(wednesday) == {"soon": (wednesday, wednesday + 3 * HOUR, False), "tonight": (seconds(2024, 3, 6, 19), seconds(2024, 3, 7, 0), True),
                             "halfday": (wednesday, wednesday + 6 * HOUR, False), "weekend": (seconds(2024, 3, 9, 0), seconds(2024, 3, 11, 0), False)}
    assert by(sunday)["weekend"] == (sunday, seconds(2024, 3, 11, 0), False)
    assert by(night)["tonight"] == (night, seconds(2024, 3, 10, 0), True) and by(night)["weekend"][0] == night


def test_moods(spark):
    rows = [("展覽", "x"), ("節慶活動", "x"), ("其他", "海邊手作市集"), ("競賽", "市集"), ("展覽", "志工招募"), (None, None)]
    df = spark.createDataFrame(rows, "cat string, title string")
    got = [r.m for r in df.select(recommend.moods_of(F.col("cat"), F.col("title")).alias("m")).collect()]
    assert got == [["solo"], ["friends", "escape"], ["friends", "escape", "different"], [], [], ["any"]]


def brute_offer(heritage, sessions, s):
    if heritage:
        return None if s.night else ("place", None)
    best = None
    for _, start, end, date_only in sorted(sessions, key=lambda x: (x[0], x[1] if x[1] is not None else 0)):
        if start is None:
            continue
        end = end or None
        if date_only or (end and end - start > 20 * HOUR):
            until = end if end is not None else start + DAY
            if not s.night and start < s.end and until > s.start and best is None:
                best = ("open", until)
        elif s.start <= start < s.end and (best is None or best[0] != "timed" or start < best[1]):
            best = ("timed", start)
    return best


def world(seed=3, n=120):
    pick, now = random.Random(seed), seconds(2024, 3, 6, 10)
    items = [(k, pick.choice([True, False, False, False, None]), pick.choice([[], ["solo"], ["friends", "solo"], ["any"]]), pick.choice([None, 1.0, 2.0, 3.0])) for k in range(n)]
    sessions = []
    for k in range(n + 5):
        for position in range(pick.randrange(0, 6)):
            start = pick.choice([None, *[now + pick.randrange(-3 * DAY, 5 * DAY) for _ in range(6)]])
            sessions.append((k, position, start, pick.choice([None, 0, *[(start or now) + x for x in (HOUR, 30 * HOUR, 4 * DAY)]]), pick.choice([True, False, None])))
    return now, items, sessions


def frames(spark, items, sessions):
    return (
        spark.createDataFrame([(*i, "x") for i in items], "slug int, heritage boolean, moods array<string>, score double, kind string").repartition(3),
        spark.createDataFrame([(*s, "x") for s in sessions], "slug int, position int, start long, end long, date_only boolean, span string").repartition(3),
    )


def brute_matches(now, items, sessions):
    for slug, heritage, moods, score in items:
        own = [s[1:] for s in sessions if s[0] == slug]
        for s in recommend.spans(now):
            offer = brute_offer(heritage, own, s)
            for mood in [*moods, "now"] if moods and offer else []:
                yield s.name, mood, slug, *offer, score or 0.0, bool(heritage)


def test_matches_and_lists(spark):
    now, items, sessions = world()
    matched = recommend.matches(*frames(spark, items, sessions), recommend.spans(now))
    want = list(brute_matches(now, items, sessions))
    assert sorted(map(tuple, matched.select("span", "mood", "slug", "kind", "at", "score", "heritage").collect()), key=repr) == sorted(want, key=repr)
    lists = {}
    for key in {w[:2] for w in want}:
        rows = [w for w in want if w[:2] == key]
        timed = sorted((w for w in rows if w[3] == "timed"), key=lambda w: (w[4], -w[5], w[2]))
        open_ = sorted((w for w in rows if w[3] != "timed"), key=lambda w: (-w[5], w[6], w[2]))
        merged = [x for k in range(max(len(timed), len(open_))) for x in (timed[k : k + 1] + open_[k : k + 1])]
        lists[key] = [w[2] for w in merged[:12]]
    got = {}
    for r in recommend.recommended(matched, 12).orderBy("span", "mood", "rank").collect():
        got.setdefault((r.span, r.mood), []).append(r.slug)
    assert got == lists


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(s)))


def test_nearest_in_rings(spark):
    """Dense points, one point that many rows share, lonely ones, and too few rows of a key."""
    pick = random.Random(2)
    point = lambda: pick.choice([(24.0, 121.0), (24 + pick.random() / 500, 121 + pick.random() / 500), (22 + 4 * pick.random(), 119 + 3 * pick.random()), (-30.0, -60.0)])
    right = [(k, *point(), "a") for k in range(600)] + [(1000 + k, *point(), "few") for k in range(3)] + [(2000, None, 121.0, "a"), (2001, 24.0, 121.0, None)]
    left = [(f"p{k}", *point(), pick.choice(["a", "a", "few", "none"])) for k in range(80)] + [("null", None, None, "a")]
    got = {}
    df = spatial.nearest_in_rings(spark.createDataFrame(left, "l_id string, lat double, lng double, g string"), spark.createDataFrame(right, "r_id int, lat double, lng double, g string"), 5, ["g"])
    for r in df.orderBy("l_id", "rank").collect():
        got.setdefault(r.l_id, []).append((round(r.metres, 3), r.r_id))
    for l_id, lat, lng, g in left:
        near = sorted((round(metres((lat, lng), r[1:3]), 3), r[0]) for r in right if r[3] == g and None not in (lat, r[1]))[:5]
        assert got.get(l_id, []) == near


def test_nearest_and_picked(spark):
    now, items, sessions = world(5)
    pick = random.Random(6)
    places = [(k, *pick.choice([(None, None), (24 + pick.random(), 121 + pick.random())])) for k in range(120)]
    people = [(f"p{k}", pick.choice([s.name for s in recommend.spans(now)]), pick.choice(["solo", "friends", "now", "none"]), 24 + pick.random(), 121.0, pick.choice([None, [], list(range(0, 120, 2)), list(range(130))])) for k in range(40)]
    matched = recommend.matches(*frames(spark, items, sessions), recommend.spans(now))
    df = spark.createDataFrame(people, "person string, span string, mood string, lat double, lng double, seen array<int>")
    lists = recommend.nearest(df, matched, spark.createDataFrame(places, "slug int, lat double, lng double"), 10)
    want, picks = {}, {}
    for person, span, mood, lat, lng, seen in people:
        slugs = {w[2] for w in brute_matches(now, items, sessions) if w[:2] == (span, mood)}
        near = sorted((0, metres((lat, lng), places[s][1:]), s) if places[s][1] is not None else (1, 0, s) for s in slugs)[:10]
        if near:
            want[person] = [s for _, _, s in near]
            draw = lambda s: hashlib.md5(f"4|{person}|{s}".encode()).hexdigest()  # noqa: E731, B023
            picks[person] = min(want[person], key=lambda s: (s in (seen or []), draw(s)))
    got = {}
    for r in lists.orderBy("person", "rank").collect():
        got.setdefault(r.person, []).append(r.slug)
    assert got == want
    assert {r.person: r.slug for r in recommend.picked(lists, df, 4, 10).collect()} == picks


def test_heritage_page(spark):
    pick, today = random.Random(9), 1000 * DAY
    sessions = []
    for _ in range(900):
        start = today + pick.randrange(-20, 12) * DAY // 2 if pick.random() < 0.97 else None
        sessions.append((pick.choice([*range(60), None]), pick.choice([*range(12), "hot", "hot", None]), start, None if start is None else pick.choice([None, start, start + 3 * DAY])))
    sessions = [(s, None if v is None else str(v), a, b) for s, v, a, b in sessions]
    venues = [(p, str(v), "site") for p in range(8) for v in pick.sample(range(12), pick.randrange(0, 3))] + [(p, str(v), "near") for p in range(8) for v in [*pick.sample(range(12), 5), "hot"]]
    keep = list(range(0, 60, 2)) + [5, 7]
    got = {}
    frame = spark.createDataFrame(sessions, "slug int, venue string, start long, end long").repartition(3)
    pages = spark.createDataFrame(venues * 2, "page int, venue string, part string")
    for r in discovery.heritage_page(frame, pages, today, spark.createDataFrame([(k,) for k in keep], "slug int"), here=6).orderBy("page", "part", "rank").collect():
        got.setdefault((r.page, r.part), []).append((r.slug, r.venue, r.start))
    want = {}
    for page in range(8):
        rows = lambda part: [s for s in sessions if None not in s[:3] and (page, s[1], part) in venues]  # noqa: E731, B023
        end = lambda s: s[3] if s[3] is not None else s[2]
        up = lambda some: sorted((s for s in some if end(s) >= today and s[2] < today), key=lambda s: (end(s), s[0], s[1], s[2])) + sorted((s for s in some if s[2] >= today), key=lambda s: (s[2], s[0], s[1]))
        once = lambda some: [s for k, s in enumerate(some) if s[0] not in {x[0] for x in some[:k]}]
        here = once(up(rows("site")))
        past = [] if here else once(sorted((s for s in rows("site") if end(s) < today), key=lambda s: (-s[2], s[0], s[1])))
        here, past = here[:6], past[:6]
        taken, per, near = {s[0] for s in here + past}, {}, []
        coming = up(rows("near"))
        for s in once([s for s in coming if s[2] >= today] + [s for s in coming if s[2] < today]):
            if len(near) < 8 and s[0] not in taken and s[0] in keep and per.get(s[1], 0) < 2:
                per[s[1]] = per.get(s[1], 0) + 1
                near.append(s)
        want |= {(page, part): [s[:3] for s in some] for part, some in (("here", here), ("past", past), ("near", near)) if some}
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert {part for _, part in got} >= {"here", "near"}


def test_empty_tables(spark):
    items, sessions = frames(spark, [], [])
    matched = recommend.matches(items, sessions, recommend.spans(0))
    assert recommend.recommended(matched).count() == 0
    none = spark.createDataFrame([], "page int, venue string, part string")
    assert discovery.heritage_page(sessions.withColumn("venue", F.lit("v")), none, 0).count() == 0


def test_sessions_without_a_position_stand_last(spark):
    now = 1_709_690_400
    span = recommend.Span("soon", now, now + 10_800)
    items = spark.createDataFrame([(1, False), (2, False)], "slug long, heritage boolean")
    rows = [(1, None, now - 5000, now + 900_000), (1, 3, now - 4000, now + 500_000), (2, 4, now - 5000, now + 700_000), (2, 4, now - 5000, now + 600_000)]
    sessions = spark.createDataFrame([(*r, False) for r in rows], "slug long, position long, start long, end long, date_only boolean")
    found = {r.slug: r.at for r in recommend.availability(items, sessions, [span]).collect()}
    assert found == {1: now + 500_000, 2: now + 600_000}
