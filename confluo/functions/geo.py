"""Coordinates, distances, cities and addresses."""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, nfkc, trim_space

EARTH_M = 6_371_000.0

# Cities and counties, other spellings and former names, names without suffix.
CITIES = [
    "臺北市", "新北市", "桃園市", "臺中市", "臺南市", "高雄市", "基隆市", "新竹市", "嘉義市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義縣",
    "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣",
]
CITY_ALIAS = {
    "台北市": "臺北市", "台中市": "臺中市", "台南市": "臺南市", "台東縣": "臺東縣", "桃園縣": "桃園市", "臺北縣": "新北市", "台北縣": "新北市", "臺中縣": "臺中市",
    "台中縣": "臺中市", "臺南縣": "臺南市", "台南縣": "臺南市", "高雄縣": "高雄市", "台灣省": "", "臺灣省": "",
}
BARE_PLACE = {
    "臺北": "臺北市", "台北": "臺北市", "新北": "新北市", "桃園": "桃園市", "臺中": "臺中市", "台中": "臺中市", "臺南": "臺南市", "台南": "臺南市", "高雄": "高雄市",
    "基隆": "基隆市", "苗栗": "苗栗縣", "彰化": "彰化縣", "南投": "南投縣", "雲林": "雲林縣", "屏東": "屏東縣", "宜蘭": "宜蘭縣", "花蓮": "花蓮縣", "臺東": "臺東縣",
    "台東": "臺東縣", "澎湖": "澎湖縣", "金門": "金門縣", "馬祖": "連江縣", "連江": "連江縣",
}


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    s = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), s)))


def metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """The same for numbers."""
    a, b = math.radians(lat1), math.radians(lat2)
    s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(s)))


def lat_lng(lat: Column, lng: Column) -> Column:
    """struct<lat, lng> within Taiwan, exchanged when that puts it there; null otherwise."""
    a, b = lat.try_cast("double"), lng.try_cast("double")
    inside = lambda x, y: x.between(21.0, 26.5) & y.between(118.0, 122.5)
    pair = lambda x, y: F.struct(x.alias("lat"), y.alias("lng"))
    return F.when(inside(a, b), pair(a, b)).when(inside(b, a), pair(b, a))


def tm2_to_wgs84(x: Column, y: Column) -> Column:
    """struct<lat, lng> of TWD97 two-degree transverse Mercator metres (GRS80, meridian 121 E, scale 0.9999).

    The series of the inverse projection around the footpoint latitude; null outside Taiwan.
    """
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9999
    e2 = f * (2 - f)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    second = e2 / (1 - e2)
    x, y = x.try_cast("double"), y.try_cast("double")
    mu = y / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    series = {2: 3 * e1 / 2 - 27 * e1**3 / 32, 4: 21 * e1**2 / 16 - 55 * e1**4 / 32, 6: 151 * e1**3 / 96, 8: 1097 * e1**4 / 512}
    foot = mu
    for k, c in series.items():
        foot = foot + c * F.sin(k * mu)
    # names for the terms keep the expression small: structs are evaluated once each through transform
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def solve(p: Column) -> Column:
        base = F.struct(
            p.alias("p"), (second * F.pow(F.cos(p), 2)).alias("c"), F.pow(F.tan(p), 2).alias("t"),
            (a * (1 - e2) / F.pow(1 - e2 * F.pow(F.sin(p), 2), 1.5)).alias("r"), (a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))).alias("n"),
        )
        return let(base, finish)

    def finish(v: Column) -> Column:
        c, t = v["c"], v["t"]
        d = (x - 250000) / (v["n"] * k0)
        bend = 5 + 3 * t + 10 * c - 4 * c * c - 9 * second
        more = 61 + 90 * t + 298 * c + 45 * t * t - 3 * c * c - 252 * second
        lat = v["p"] - v["n"] * F.tan(v["p"]) / v["r"] * (F.pow(d, 2) / 2 - bend * F.pow(d, 4) / 24 + more * F.pow(d, 6) / 720)
        side = 5 - 2 * c + 28 * t - 3 * c * c + 8 * second + 24 * t * t
        lng = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + side * F.pow(d, 5) / 120) / F.cos(v["p"])
        return F.struct(F.round(F.degrees(lat), 6).alias("lat"), F.round(121 + F.degrees(lng), 6).alias("lng"))

    found = let(foot, solve)
    ok = (x > 0) & (y > 0) & (found["lat"] > 21) & (found["lat"] < 26.5) & (found["lng"] > 118) & (found["lng"] < 122.5)
    return F.when(ok, found)


def cell(lat: Column, lng: Column, degrees: float) -> Column:
    """struct of the grid cell of a point."""
    return F.struct(F.floor(lat / degrees).alias("y"), F.floor(lng / degrees).alias("x"))


def cells_around(lat: Column, lng: Column, degrees: float) -> Column:
    """The nine cells around a point."""
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    return F.transform(offsets, lambda o: F.struct((F.floor(lat / degrees) + o["dy"]).alias("y"), (F.floor(lng / degrees) + o["dx"]).alias("x")))


def normalize_city(value: Column, allow_bare: bool = False) -> Column:
    """The present name of the first city or county in a text, in the fixed order; null when there is none."""
    s = trim_space(value)
    names = {c: c for c in CITIES} | CITY_ALIAS
    exact, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, full in reversed(names.items()):
        exact = F.when(s == name, F.lit(full or None)).otherwise(exact)
        inside = F.when(F.contains(s, F.lit(name)), F.lit(full or None)).otherwise(inside)
    known = F.when(s.isin(*names), exact).when(F.rlike(s, F.lit("|".join(names))), inside)
    if not allow_bare:
        return known
    bare = F.lit(None).cast("string")
    for name, full in reversed(BARE_PLACE.items()):
        bare = F.when(F.contains(s, F.lit(name)), F.lit(full)).otherwise(bare)
    return F.when(F.rlike(s, F.lit("|".join(names))), known).otherwise(bare)


# --- addresses -----------------------------------------------------------------------------------------------------------

# Post codes, what ends a district, and what only street addresses have.
POSTCODE = r"^(?:\d{6}|\d{5}|\d{3})[\s-]*(?=[一-鿿])"
DISTRICT = "^[一-鿿]{1,3}[區鄉鎮市]$"
STREET = "[0-9０-９]+\\s*(?:號|樓)|[路街道巷弄]"


def address_parser(districts: dict[str, list[str]] | None = None):
    """A function of columns (raw, city hint, district hint) -> struct of city, district, address and its precision.

    ``districts`` is a gazetteer: the districts of each city. What follows the city is a district if two to four characters
    end like one; the gazetteer decides between several, else the shortest counts, and it completes a hint without its
    ending. Precision is street, district, city or venue-name-only, and null without any location.
    """
    names = {c: c for c in CITIES} | CITY_ALIAS
    gazetteer = F.create_map(*(x for c, d in districts.items() for x in (F.lit(c), F.array(*map(F.lit, d))))) if districts else None
    none = F.array().cast("array<string>")

    def known_in(city: Column) -> Column:
        return F.coalesce(F.element_at(gazetteer, city), none) if gazetteer is not None else none

    def parse(raw: Column, city_hint: Column, district_hint: Column) -> Column:
        text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), POSTCODE, "")
        # the first name of the list that the text holds, and what stands behind it
        cuts = [F.when(F.contains(text, F.lit(n)), F.struct(F.lit(full or None).cast("string").alias("city"), F.substr(text, F.locate(n, text) + len(n)).alias("rest"))) for n, full in names.items()]
        hint = F.trim(F.coalesce(city_hint, F.lit("")))
        place = F.coalesce(*cuts, F.struct(normalize_city(F.when(hint != "", hint)).alias("city"), text.alias("rest")))
        return F.transform(F.array(F.struct(text.alias("text"), place.alias("place"))), lambda v: _located(v["text"], v["place"]["city"], F.ltrim(v["place"]["rest"]), F.trim(F.coalesce(district_hint, F.lit("")))))[0]

    def _located(text: Column, city: Column, rest: Column, hint: Column) -> Column:
        heads = F.array(*(F.substring(rest, 1, n) for n in (2, 3, 4)))
        heads = F.filter(F.array_distinct(heads), lambda h: F.rlike(h, F.lit(DISTRICT)))
        whole = F.coalesce(F.get(F.filter(known_in(city), lambda d: F.startswith(d, hint)), F.lit(0)), F.lit(""))
        hinted = F.when((hint == "") | F.rlike(hint, F.lit("[區鄉鎮市]$")), hint).otherwise(whole)
        found = F.coalesce(F.get(F.filter(heads, lambda h: F.array_contains(known_in(city), h)), F.lit(0)), F.get(heads, F.lit(0)))
        district = F.coalesce(found, hinted)
        behind = F.when(found.isNotNull(), F.substr(rest, F.length(found) + 1)).otherwise(rest)
        street = (text != "") & city.isNotNull() & F.rlike(behind, F.lit(STREET))
        precision = F.when(street, "street").when(district != "", "district").when(city.isNotNull(), "city").when(text != "", "venue-name-only")
        return F.struct(city.alias("city"), F.nullif(district, F.lit("")).alias("district"), F.nullif(text, F.lit("")).alias("address"), precision.alias("precision"))

    return parse


_DIGITS = {c: n for n, c in enumerate("〇一二三四五六七八九")} | {"零": 0}


def _number(han: str) -> str:
    """A Chinese numeral below one hundred, or digits in sequence; what is neither stays."""
    if "十" not in han:
        return str(int("".join(str(_DIGITS[c]) for c in han)))
    tens, _, ones = han.partition("十")
    if len(tens) > 1 or len(ones) > 1:
        return han
    return str((_DIGITS[tens] if tens else 1) * 10 + (_DIGITS[ones] if ones else 0))


def house_number_form(t: str | None) -> str | None:
    """An address up to its house number, for comparing; null without one."""
    if t is None:
        return None
    t = "".join(c for c in unicodedata.normalize("NFKC", t).replace("台", "臺") if not c.isspace() and unicodedata.category(c)[0] not in "PS")
    t = re.sub(r"([〇零一二三四五六七八九十]+)(?=[段巷弄號樓])", lambda m: _number(m[1]), t)
    t = re.sub(r"\d+鄰", "", t)
    for m in re.finditer("里", t):  # the first village behind a district, unless a road is named after it
        head = re.search(r"[區鄉鎮市]([^\d區鄉鎮市路街道段巷弄號]{1,3})$", t[: m.start()])
        if head and t[m.end() : m.end() + 1] not in ("路", "街", "道"):
            t = t[: head.start(1)] + t[m.end() :]
            break
    end = re.search(r"\d(?:之\d+)?號", t)
    return t[: end.end()] if end else None


@functools.lru_cache(maxsize=1)
def _address_udf():
    return F.pandas_udf(lambda s: s.map(house_number_form), "string")


def norm_address(address: Column) -> Column:
    """House-number form: Chinese numerals before section, lane, alley, number and floor as digits, neighbourhoods dropped, cut after the number."""
    return _address_udf()(address)


# Owners in front of venue names; a city stands there by its first two characters.
OWNERS = ["國立", "市立", "縣立", "私立"]


def venue_identity_key(name: Column) -> Column:
    """Venue name without punctuation, symbols, white space, and up to three times a city and an owner in front; lower case.

    A city that is part of an owner, as in a city's own museum, stays in front.
    """
    s = F.regexp_replace(F.translate(nfkc(F.coalesce(name, F.lit(""))), "台", "臺"), rf"[\p{{P}}\p{{S}}{SPACE}]", "")
    s = F.lower(s)
    cities = "|".join(dict.fromkeys(c[:2] for c in CITIES))
    for _ in range(3):
        s = F.regexp_replace(s, f"^(?:{cities})[市縣]?(?![市縣]?立)", "")
        s = F.regexp_replace(s, f"^(?:{'|'.join(OWNERS)})", "")
    return s
