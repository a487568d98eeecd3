"""The cascade of resolution against one walk over the names in order."""

import math
import random
import re

from confluo.operators import resolution

SESSION = "name string, position long, city string, district string, address string, precision string, lat double, lng double"
VENUE = "id string, ord int, name string, city string, district string, address string, precision string, lat double, lng double, sources int"
CITY = "臺北|新北|桃園|臺中|臺南|高雄|基隆|新竹|嘉義|苗栗|彰化|南投|雲林|屏東|宜蘭|花蓮|臺東|澎湖|金門|連江"
OWNER = "國立|市立|縣立|私立"


def norm(s):
    return re.sub(f"^({OWNER})", "", re.sub(r"[\s\-–—_()（）]", "", s or "")).lower()


def identity(s):
    s = re.sub(r"[\s\W_]", "", (s or "").replace("台", "臺")).lower()
    for _ in range(3):
        s = re.sub(f"^({OWNER})", "", re.sub(f"^({CITY})(市|縣)?(?![市縣]?立)", "", s))
    return s


def house(a):
    m = re.match(r"^.*?\d+號", re.sub(r"\s", "", a or ""))
    return m[0] if m else None


def metres(a, b):
    la, lb = math.radians(a["lat"]), math.radians(b["lat"])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(s)))


def same_place(a, b):
    if a["city"] and b["city"] and a["city"] != b["city"]:
        return False
    if a["lat"] is not None and b["lat"] is not None:
        return metres(a, b) <= 100
    return house(a["address"]) is not None and house(a["address"]) == house(b["address"])


def fullest(ids, venues):
    some = [venues[i] for i in ids]
    located = [v for v in some if v["lat"] is not None]
    if any(metres(located[0], v) > 100 for v in located[1:]) or len({v["district"] for v in some if v["district"]}) > 1:
        return None
    return min(enumerate(some), key=lambda x: (x[1]["lat"] is None, x[1]["precision"] != "street", not x[1]["district"], -(x[1]["sources"] or 0), x[0]))[1]["id"]


def brute(sessions, registry, spellings, aliases, rejected, pages):
    fields = [f.split()[0] for f in VENUE.split(", ")]
    venues = {r[0]: dict(zip(fields, r)) for r in sorted(registry, key=lambda r: r[1])}
    keys = {}
    for v in venues.values():
        for name in [v["name"], *(n for i, n in spellings if i == v["id"])]:
            if norm(name):
                keys.setdefault(norm(name), [])
                keys[norm(name)] += [v["id"]] if v["id"] not in keys[norm(name)] else []
    seen = {}
    for s in sorted((s for s in sessions if norm(s[0])), key=lambda s: s[1]):
        e = seen.setdefault(norm(s[0]), dict(key=norm(s[0]), name=s[0], n=0, position=s[1], city=None, district=None, address=None, lat=None, lng=None))
        e["n"] += 1
        for k, v in zip(("city", "district", "address"), s[2:5]):
            e[k] = v if e[k] is None else e[k]
        if e["lat"] is None and s[6] is not None:
            e["lat"], e["lng"] = s[6:8]
    out, made, places = {}, {}, []
    known = dict(sorted(keys.items(), key=lambda kv: (min(venues[i]["ord"] for i in kv[1]), kv[0])))

    def holding(k, e, itself):
        return [i for nk, ids in known.items() if k in nk and (itself or nk != e["key"]) for i in ids if not (e["city"] and venues[i]["city"] and e["city"] != venues[i]["city"])]

    def decide(e):
        k, name = e["key"], e["name"]
        if name in rejected:
            return None, "rejected", "manual"
        target = aliases.get(name, aliases.get(k))
        wanted = norm(target) if target else k
        hit = known.get(wanted)
        if hit is None and target and wanted in made:
            return made[wanted], "resolved", "alias"
        if hit:
            if len(hit) == 1:
                return hit[0], "resolved", "alias" if target else "exact-name"
            best = fullest(hit, venues)
            return (best, "resolved", "exact-name-merged") if best else (None, "ambiguous", "exact-name")
        if len(k) >= 4:
            some = holding(k, e, False)
            if len(some) == 1:
                return some[0], "resolved", "name-contains"
            if some:
                best = fullest(some, venues)
                return (best, "resolved", "name-contains-merged") if best else (None, "ambiguous", "name-contains")
            head = re.match("^.{2,12}?(?:分館|圖書館|文化中心|藝術中心|中心|館)", name)
            hk = norm(head[0]) if head else ""
            if len(hk) >= 4 and hk != k and len(some := holding(hk, e, True)) == 1:
                return some[0], "resolved", "name-head"
        if e["lat"] is None and not e["address"]:
            return None, "unresolved", "none"
        idk = identity(name)
        if len(idk) >= 4:
            for part in [idk, *(idk[i:] for i in range(2, len(idk) - 3))]:
                some = [v["id"] for v in venues.values() if identity(v["name"]) == part and same_place(e, v)]
                best = some[0] if len(some) == 1 else fullest(some, venues) if some else None
                if best:
                    if venues[best]["lat"] is None and e["lat"] is not None:
                        venues[best]["lat"], venues[best]["lng"] = e["lat"], e["lng"]
                    return best, "resolved", "same-place"
                if some and part != idk:
                    break
            some = [p for p in places if p["idk"] == idk and same_place(e, p)]
            if len(some) == 1:
                p = some[0]
                p["address"] = p["address"] or e["address"]
                if p["lat"] is None:
                    p["lat"], p["lng"] = e["lat"], e["lng"]
                p["members"].append(e)
                made[k] = p
                return p, "resolved", "derived"
        place = dict(idk=idk if len(idk) >= 4 else None, city=e["city"], address=e["address"], lat=e["lat"], lng=e["lng"], members=[e])
        places.append(place)
        made[k] = place
        return place, "resolved", "derived"

    for e in sorted(seen.values(), key=lambda e: (-e["n"], e["position"], e["key"])):
        out[e["key"]] = decide(e)
    rows = []
    for k, (place, state, method) in out.items():
        if isinstance(place, dict):
            best = min(place["members"], key=lambda m: (m["name"] not in pages, not re.match(f"^({OWNER})", m["name"].replace("台", "臺")), "台" in m["name"], -m["n"], m["name"]))
            if method == "derived" and best["key"] != k:
                method = "same-place"
            place = "derived:" + best["key"]
        rows.append((k, seen[k]["n"], place, state, method, resolution.METHODS[method] if state == "resolved" else None))
    return sorted(rows)


def world(seed):
    pick = random.Random(seed)
    cores = ["中山大禮堂", "文化中心", "南海劇場", "新館甲乙", "丙館"]
    name = lambda: pick.choice(["", "", "臺北市", "台北", "國立", "市立", "私立"]) + pick.choice(cores) + pick.choice(["", "", "", "二樓", "-", " 分館二室", "東區分館"])
    city = lambda: pick.choice(["臺北市", "臺北市", "臺南市", None])
    spots = [(25.0 + 0.0006 * k, 121.5) for k in range(4)] + [(23.0, 120.2)]
    point = lambda: pick.choice([*spots, (None, None), (None, None)])
    address = lambda: pick.choice([None, None, "中山路1號", "中山路1號2樓", "中山路2號", "中山路"])
    registry = [(f"v{k}", k, pick.choice(["", "國立", "臺北市"]) + pick.choice([*cores[:3], "新館甲乙圖書館", "南海劇場前廳", "大文化中心東區分館"]), city(), pick.choice(["x", "y", None, None]), address(), pick.choice(["street", None]), *point(), pick.choice([1, 2, None])) for k in range(pick.randrange(0, 9))]
    sessions = [(pick.choice([None, "", "  "]) if pick.random() < 0.02 else name(), k, city(), None, address(), None, *point()) for k in range(250)]
    sessions += [(f"{pick.choice(['甲', '乙'])}南海劇場", 1000 + k, "臺北市", None, "中山路1號", None, *point()) for k in range(5)]
    spellings = [(r[0], name()) for r in registry if pick.random() < 0.2]
    every = [s[0] for s in sessions if s[0]]
    aliases = {pick.choice(every): pick.choice([*every, *(r[2] for r in registry)]) for _ in range(6)} | {norm(pick.choice(every)): pick.choice(every) for _ in range(3)}
    return sessions, registry, spellings, aliases, {pick.choice(every) for _ in range(2)}, {pick.choice(every) for _ in range(4)}


def run(spark, sessions, registry, spellings, aliases, rejected, pages):
    found = resolution.resolve(
        spark.createDataFrame(sessions, SESSION).repartition(3), spark.createDataFrame(registry, VENUE).repartition(2), spark.createDataFrame(spellings, "id string, name string"),
        spark.createDataFrame(list(aliases.items()), "alias string, target string"), spark.createDataFrame([(x,) for x in rejected], "name string"), spark.createDataFrame([(x,) for x in pages], "name string"))
    return sorted(tuple(r) for r in found.select("key", "sessions", "place", "state", "method", "confidence").collect())


def test_same_as_one_walk(spark):
    methods = set()
    for seed in (1, 2, 3, 8, 9, 11):
        data = world(seed)
        want = brute(*data)
        assert run(spark, *data) == want, seed
        methods |= {(r[3], r[4]) for r in want}
    assert len(methods) == 12, methods


def test_effects_between_names(spark):
    """The venue gains coordinates from the first name, so the third is near it; an alias means a place that sessions made."""
    registry = [("v1", 0, "南海劇場", "臺北市", None, "中山路1號", None, None, None, 1)]
    rows = [("臺北南海劇場", "中山路1號", 25.0, 121.5)] * 3 + [("台北市南海劇場", None, 25.0003, 121.5)] * 2 + [("高樓上的南海劇場", "中山路1號", 26.0, 121.5)] + [("森林小屋四號", None, 25.5, 121.5)] * 2 + [("小屋", None, None, None)]
    sessions = [(n, k, "臺北市", None, a, None, la, lo) for k, (n, a, la, lo) in enumerate(rows)]
    data = (sessions, registry, [], {"小屋": "森林小屋四號"}, set(), set())
    got = run(spark, *data)
    assert got == brute(*data)
    assert {r[0]: r[2] for r in got} == {"臺北南海劇場": "v1", "台北市南海劇場": "v1", "高樓上的南海劇場": "derived:高樓上的南海劇場", "森林小屋四號": "derived:森林小屋四號", "小屋": "derived:森林小屋四號"}


def test_empty_tables(spark):
    assert run(spark, [], [], [], {}, set(), set()) == []
