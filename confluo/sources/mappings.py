"""Field mappings of single sources: payload columns as expressions over bronze columns, compacted at every depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, geo, nested, predicates, text
from ..operators.lifecycle import content_hash
from .connectors import Mapping


def _moment(value: Column) -> Column:
    """A moment of a source that writes ASCII digits; it works inside arrays too."""
    return dates.parse_clean(text.trim_space(value))


def _number(value: Column) -> Column:
    """A number; zero and what is none are missing."""
    n = value.try_cast("double")
    return F.when(n != 0, n)


def _either(*values: str) -> Column:
    return F.coalesce(*(text.non_empty(F.col(v)) for v in values))


def _yes_no(value: Column) -> Column:
    v = F.lower(text.trim_space(value))
    return F.when(v.isin("true", "y", "yes", "是", "1"), True).when(v.isin("false", "n", "no", "否", "0"), False)


def _points(lat: Column, lng: Column, lats: tuple[float, float], lngs: tuple[float, float]) -> Column:
    """struct<lat, lng>, exchanged where that puts them into the ranges; null if neither does."""
    a, b = _number(lat), _number(lng)
    pair = lambda x, y: F.when(x.between(*lats) & y.between(*lngs), F.struct(x.alias("lat"), y.alias("lng")))
    return F.coalesce(pair(a, b), pair(b, a))


def compacted(rows: DataFrame, *keys: str) -> DataFrame:
    """All columns but the keys without what is missing."""
    return rows.select(*(F.col(f.name) if f.name in keys else nested.compacted(f.dataType, F.col(f.name)).alias(f.name) for f in rows.schema.fields))


def _image(url: Column, caption: Column | None = None) -> Column:
    return F.struct(url.alias("url"), (caption if caption is not None else F.lit(None).cast("string")).alias("caption"))


# --- events of the ministry ---------------------------------------------------------------------------------------------------

PROGRAM = "opentix.life/program/"


def moc_events(districts: dict[str, list[str]] | None = None) -> Mapping:
    """Events with their sessions; sessions without a start go, and events without a session."""
    parse = geo.address_parser(districts)
    ticket = F.regexp_extract(F.substring_index(_either("webSales", "sourceWebPromote"), PROGRAM, -1), r"^\d+", 0)

    none = F.lit(None).cast("string")

    def session(s: Column) -> Column:
        read = F.struct(_moment(s["time"]).alias("start"), _moment(s["endTime"]).alias("end"), parse(s["location"], none, none).alias("place"))
        return F.transform(F.array(read), lambda r: F.struct(  # each part is read once
            r["start"]["value"].alias("start_at"), r["start"]["granularity"].alias("granularity"), r["end"]["value"].alias("end_at"), F.when(s["onSales"] == "Y", True).when(s["onSales"] == "N", False).alias("on_sales"),
            predicates.venue_label(s["locationName"], none).alias("venue_name_raw"), *(r["place"][c].alias(c) for c in ("city", "district", "address")), r["place"]["precision"].alias("address_precision"),
            _number(s["latitude"]).alias("lat"), _number(s["longitude"]).alias("lng")))[0]

    def prepared(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_sessions", F.transform("showInfo", session)).withColumn("_kept", F.filter("_sessions", lambda s: s["start_at"].isNotNull()))

    units = [(F.array_join(c, "、"), role) for c, role in (("masterUnit", "master"), ("subUnit", "sub"), ("supportUnit", "support"), ("otherUnit", "other"))]
    return Mapping(
        "moc-events", F.col("UID"),
        {
            "source_name": F.col("sourceWebName"), "source_url": _either("sourceWebPromote", "webSales"), "source_updated_at": _moment(F.col("editModifyDate"))["value"], "external_ids": F.when(F.contains(_either("webSales", "sourceWebPromote"), F.lit(PROGRAM)) & (ticket != ""), F.create_map(F.lit("opentix"), ticket)),
            "title": F.col("title"), "description": F.col("descriptionFilterHtml"), "images": F.when(F.col("imageUrl") != "", F.array(_image(F.col("imageUrl")))), "category_raw": F.col("category"), "popularity": F.col("hitRate"),
            "performers": text.split_performers(F.col("showUnit")), "organizers": text.organizers(*units), "price_text": F.col("discountInfo"), "ticket_url": F.col("webSales"), "sessions": F.col("_kept"),
        },
        keep=F.coalesce(F.size("_kept") > 0, F.lit(False)), prepare=prepared,
        schema="struct<UID: string, title: string, category: string, showUnit: string, descriptionFilterHtml: string, imageUrl: string, masterUnit: array<string>, subUnit: array<string>, supportUnit: array<string>, otherUnit: array<string>, discountInfo: string, webSales: string, sourceWebPromote: string, sourceWebName: string, editModifyDate: string, hitRate: double, "
        "showInfo: array<struct<time: string, endTime: string, location: string, locationName: string, onSales: string, latitude: string, longitude: string>>>",
    )


# --- heritage ---------------------------------------------------------------------------------------------------------------------

# The part of a case's address on the web and its category.
HERITAGE_CATEGORIES = {
    "monument": "古蹟", "historicalBuilding": "歷史建築", "groupsOfBuildings": "聚落建築群", "commemorativeBuilding": "紀念建築", "archaeologicalSite": "考古遺址", "culturalLandscape": "文化景觀", "historicSite": "史蹟",
    "traditionalPerformingart": "傳統表演藝術", "traditionalCraft": "傳統工藝", "folklore": "民俗", "ote": "口述傳統", "tkp": "傳統知識與實踐", "antiquity": "古物",
}
REGISTERED = "指定/登錄"
HERITAGE_LATS, HERITAGE_LNGS = (20, 27), (118, 123)


def boch_heritage(districts: dict[str, list[str]] | None = None) -> Mapping:
    """Heritage cases: the address of the smallest number, completed by its city and district, the first registration, each image once."""
    parse = geo.address_parser(districts)
    names = F.create_map(*(F.lit(x) for pair in HERITAGE_CATEGORIES.items() for x in pair))
    behind = F.when(F.contains("caseUrl", F.lit("advanceSearch/")), F.substring_index("caseUrl", "advanceSearch/", -1))
    category = F.when(F.contains(behind, F.lit("/")), F.element_at(names, F.substring_index(behind, "/", 1)))

    none = F.lit(None).cast("string")
    media = F.coalesce("mediaImageList", F.array().cast("array<struct<url: string, mediaName: string>>"))

    def prepared(rows: DataFrame) -> DataFrame:
        """Intermediate results as columns, each worked out once."""
        every = F.concat(F.array(_image(F.col("representImage.original"), F.col("representImage.name"))), F.transform(media, lambda m: _image(m["url"], m["mediaName"])))
        rows = rows.withColumn("_every", F.filter(every, lambda x: F.coalesce(x["url"] != "", F.lit(False))))
        numbered = F.transform(F.filter("addresses", lambda a: a.isNotNull()), lambda a, k: F.struct(F.coalesce(a["itemNo"], F.lit(0)).alias("n"), k.alias("k"), a.alias("a")))
        rows = rows.withColumn("_first", F.array_min(numbered)["a"])
        rows = rows.withColumns({f"_{c}": text.non_empty(F.col(f"_first.{n}")) for c, n in (("city", "cityName"), ("district", "distName"), ("said", "address"))})
        rows = rows.withColumn("_probe", parse(F.col("_said"), none, none))
        longer = F.when(F.col("_probe.district").isNull() & F.col("_district").isNotNull() & ~F.contains("_said", "_district"), F.concat("_district", "_said")).otherwise(F.col("_said"))
        rows = rows.withColumn("_longer", longer)
        whole = F.when(F.col("_said").isNull(), F.nullif(F.concat_ws("", "_city", "_district"), F.lit(""))).when(F.col("_probe.city").isNull() & F.col("_city").isNotNull(), F.concat("_city", "_longer")).otherwise(F.col("_longer"))
        rows = rows.withColumn("_whole", whole).withColumn("_place", parse(F.col("_whole"), F.col("_city"), F.col("_district")))
        return rows.withColumn("_point", _points(F.col("latitude"), F.col("longitude"), HERITAGE_LATS, HERITAGE_LNGS)).withColumn("_days", F.filter("announcementList", lambda a: a["classification"] == REGISTERED))

    images = F.filter("_every", lambda x, k: ~F.exists(F.slice("_every", 1, k), lambda y: y["url"] == x["url"]))
    days = F.transform("_days", lambda a: F.substring(_moment(a["registerDate"])["value"], 1, 10))
    place = {c: F.when(F.col("_whole").isNotNull(), F.col(f"_place.{c}")) for c in ("city", "district", "address", "precision")}
    point = {c: F.col(f"_point.{c}") for c in ("lat", "lng")}
    return Mapping(
        "boch-heritage", F.col("caseId"),
        {
            "source_name": F.lit("國家文化資產網"), "source_url": F.col("caseUrl"), "external_ids": F.create_map(F.lit("boch"), F.col("caseId")), "name": F.col("caseName"), "images": images, "category_raw": category, "level": F.col("assetsClassifyName"),
            "heritage_types": F.col("assetsTypes"), "history": _either("pastHistory", "historyDevelopment"), "registered_at": F.array_min(days), "gov_institution": _either("govInstitution", "govInstitutionName"), "register_reason": F.col("registerReason"),
            "building_features": F.col("buildingFeatures"), "is_open_visit": _yes_no(F.col("isOpenVisit")), "open_visit_text": F.col("openVisitTypeText"), "is_charge": _yes_no(F.col("isCharge")), "opening_hours_raw": F.col("openUpTime"),
            "website": text.norm_url(F.col("wenSiteaddress")), **{c: place[c] for c in ("city", "district", "address")}, "address_precision": place["precision"], "lat": point["lat"], "lng": point["lng"],
        },
        prepare=prepared,
        schema="struct<caseId: string, caseUrl: string, caseName: string, assetsClassifyName: string, assetsTypes: array<struct<code: string, name: string>>, pastHistory: string, historyDevelopment: string, govInstitution: string, govInstitutionName: string, registerReason: string, buildingFeatures: string, isOpenVisit: string, "
        "openVisitTypeText: string, isCharge: string, openUpTime: string, wenSiteaddress: string, latitude: string, longitude: string, representImage: struct<original: string, name: string>, mediaImageList: array<struct<url: string, mediaName: string>>, announcementList: array<struct<classification: string, registerDate: string>>, "
        "addresses: array<struct<itemNo: int, cityName: string, distName: string, address: string>>>",
    )


# --- points of the culture map -----------------------------------------------------------------------------------------------------

# What each type is, and its name where the source leaves it out.
POINT_ENTITIES = {"A": "heritage", "D": "organization"}
POINT_TYPES = {
    "A": "文化資產", "B": "工藝之家", "C": "地方文化館", "D": "社區", "E": "文化景觀", "F": "公共藝術", "G": "展演空間", "H": "博物館", "I": "文化行政據點", "K": "特色圖書館", "L": "文創商店", "M": "實體書店", "N": "工藝工作室",
}
POINT_LATS, POINT_LNGS = (21, 26.5), (118, 122.5)


def moc_emap_poi(districts: dict[str, list[str]] | None = None) -> Mapping:
    """Points of several kinds; rows that share type and key are numbered, by name and then by all columns."""
    parse = geo.address_parser(districts)
    kinds, types = (F.create_map(*(F.lit(x) for pair in table.items() for x in pair)) for table in (POINT_ENTITIES, POINT_TYPES))
    def prepared(rows: DataFrame) -> DataFrame:
        order = ["name", *(c for c in rows.columns if c != "name")]
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_typeId", "mainTypePk").orderBy(*order)))
        rows = rows.withColumns({"_city": text.non_empty(F.col("cityName")), "_said": text.non_empty(F.col("address"))}).withColumn("_known", geo.normalize_city(F.col("_said")))
        rows = rows.withColumn("_whole", F.when(F.col("_known").isNull() & F.col("_city").isNotNull(), F.concat("_city", "_said")).otherwise(F.col("_said")))
        return rows.withColumn("_place", parse(F.col("_whole"), F.col("_city"), F.lit(None).cast("string"))).withColumn("_point", _points(F.col("latitude"), F.col("longitude"), POINT_LATS, POINT_LNGS))

    place = {c: F.col(f"_place.{c}") for c in ("city", "district", "address", "precision")}
    point = {c: F.col(f"_point.{c}") for c in ("lat", "lng")}
    key = F.concat_ws("-", F.col("_typeId"), F.col("mainTypePk"), F.when(F.col("_n") > 1, F.col("_n").cast("string")))
    return Mapping(
        "moc-emap-poi", key,
        {
            "source_url": F.col("srcWebsite"), "name": F.col("name"), "description": F.col("intro"), "images": F.when(F.col("representImage") != "", F.array(_image(F.col("representImage")))), "category_raw": F.coalesce(text.non_empty(F.col("groupTypeName")), F.element_at(types, F.col("_typeId"))),
            "popularity": F.col("hitRate"), **{c: place[c] for c in ("city", "district", "address")}, "address_precision": place["precision"], "lat": point["lat"], "lng": point["lng"], "opening_hours_raw": F.col("openTime"), "phone": F.col("phone"), "email": F.col("email"), "website": F.col("website"),
        },
        entity=F.coalesce(F.element_at(kinds, F.col("_typeId")), F.lit("venue")), prepare=prepared,
        schema="struct<_typeId: string, mainTypePk: string, name: string, intro: string, representImage: string, groupTypeName: string, cityName: string, address: string, latitude: string, longitude: string, openTime: string, phone: string, email: string, website: string, srcWebsite: string, hitRate: double>",
    )


#: The sources whose fields are written out.
MAPPINGS = {"moc-events": moc_events, "boch-heritage": boch_heritage, "moc-emap-poi": moc_emap_poi}


def observations(source: str, bronze: DataFrame, day: Column) -> DataFrame:
    """Observations of one of MAPPINGS, compacted; the content hash is that of the compacted payload."""
    mapping = MAPPINGS[source]()
    rows = mapping.apply(bronze, day).drop("content_hash")
    return compacted(rows, "id", "source", "source_record_id", "entity_kind", "observed_at").withColumn("content_hash", content_hash(*mapping.columns))


def bronze_type(source: str) -> T.DataType:
    return T._parse_datatype_string(MAPPINGS[source]().schema)
