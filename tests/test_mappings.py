"""Field mappings on records in the form of their sources."""

import json

from pyspark.sql import functions as F

from confluo.sources import mappings




def run(spark, tmp_path, source, records):
    path = tmp_path / source
    path.mkdir()
    (path / "a.json").write_text("﻿" + json.dumps(records, ensure_ascii=False), encoding="utf-8")
    rows = mappings.observations(source, mappings.MAPPINGS[source]().read(spark, str(path)), F.lit("2026-08-01").cast("date"))
    return {r["source_record_id"]: {k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows.collect()}


def test_events_of_the_ministry(spark, tmp_path):
    full = {
        "UID": "u1", "title": " 音樂會 ", "category": "1", "showUnit": "(日本)甲團/乙(法國)丙", "descriptionFilterHtml": "", "imageUrl": "http://i/1.jpg", "masterUnit": ["主辦一", "主辦二"], "subUnit": [], "otherUnit": [""], "discountInfo": "票價 100",
        "webSales": "https://www.opentix.life/program/12345?x", "sourceWebPromote": "", "sourceWebName": "售票網", "editModifyDate": "2026/07/01 10:00:00", "hitRate": 7,
        "showInfo": [
            {"time": "2026/08/02 19:30:00", "endTime": "2026/08/02 21:00:00", "location": "臺中市西屯區惠來路二段101號", "locationName": "大劇院", "onSales": "Y", "latitude": "24.16", "longitude": "120.64"},
            {"time": "2026/8/3", "endTime": "", "location": "", "locationName": "金沙鎮（金門縣）=", "onSales": "N", "latitude": "0", "longitude": ""}, {"time": "未定", "location": "x"},
        ],
    }
    got = run(spark, tmp_path, "moc-events", [full, {"UID": "u2", "title": "無場次", "showInfo": []}, {"UID": "u3", "title": "無時間", "showInfo": [{"time": ""}]}])
    assert set(got) == {"u1"}
    r = got["u1"]
    assert r["id"] == "moc-events:u1" and r["entity_kind"] == "event" and r["title"] == "音樂會" and "description" not in r and r["external_ids"] == {"opentix": "12345"} and r["popularity"] == 7.0
    assert r["source_url"] == r["ticket_url"] == "https://www.opentix.life/program/12345?x" and r["source_updated_at"] == "2026-07-01T10:00:00+08:00"
    assert [p["name_raw"] for p in r["performers"]] == ["甲團", "乙", "丙"] and [(o["name_raw"], o["role"]) for o in r["organizers"]] == [("主辦一", "master"), ("主辦二", "master")]
    a, b = r["sessions"]
    assert (a["start_at"], a["end_at"], a["granularity"], a["on_sales"], a["venue_name_raw"], a["city"], a["address_precision"], a["lat"], a["lng"]) == ("2026-08-02T19:30:00+08:00", "2026-08-02T21:00:00+08:00", "datetime", True, "大劇院", "臺中市", "street", 24.16, 120.64)
    assert (b["start_at"], b["end_at"], b["on_sales"], b["venue_name_raw"], b["lat"], b["city"]) == ("2026-08-03", None, False, None, None, None)


def test_heritage_cases(spark, tmp_path):
    full = {
        "caseId": "c1", "caseUrl": "https://nchdb.boch.gov.tw/assets/advanceSearch/monument/c1", "caseName": "某宅", "assetsClassifyName": "直轄市定古蹟", "assetsTypes": [{"code": "1.1", "name": "宅第"}], "pastHistory": "", "historyDevelopment": "沿革",
        "govInstitutionName": "市政府", "isOpenVisit": "True", "openVisitTypeText": "部分開放參觀", "isCharge": "否", "openUpTime": "8:30~17:30", "wenSiteaddress": "someone@yahoo.com.tw", "latitude": "120.2", "longitude": "22.9",
        "representImage": {"original": "http://i/1", "name": "正面"}, "mediaImageList": [{"url": "http://i/1", "mediaName": "again"}, {"url": "http://i/2", "mediaName": None}, {"url": "", "mediaName": "x"}],
        "announcementList": [{"classification": "變更/修正", "registerDate": "1990-01-01 00:00:00.0"}, {"classification": "指定/登錄", "registerDate": "2004-05-06 00:00:00.0"}, {"classification": "指定/登錄", "registerDate": "1998-04-30 00:00:00.0"}],
        "addresses": [{"itemNo": 2, "cityName": "臺南市", "distName": "北區", "address": "別處1號"}, {"itemNo": 1, "cityName": "臺南市", "distName": "中西區", "address": "民生路8鄰5號"}],
    }
    bare = {"caseId": "c2", "caseUrl": "x", "latitude": "25.06", "longitude": "21.2", "addresses": [{"cityName": "臺東縣", "distName": "", "address": " "}]}
    got = run(spark, tmp_path, "boch-heritage", [full, bare, {"caseId": "c3"}])
    r = got["c1"]
    assert (r["category_raw"], r["level"], r["history"], r["registered_at"], r["gov_institution"], r["is_open_visit"], r["is_charge"], r["opening_hours_raw"]) == ("古蹟", "直轄市定古蹟", "沿革", "1998-04-30", "市政府", True, False, "8:30~17:30")
    assert "website" not in r and (r["lat"], r["lng"]) == (22.9, 120.2) and r["external_ids"] == {"boch": "c1"} and r["heritage_types"] == [{"code": "1.1", "name": "宅第"}]
    assert r["images"] == [{"url": "http://i/1", "caption": "正面"}, {"url": "http://i/2", "caption": None}]
    assert (r["city"], r["district"], r["address"], r["address_precision"]) == ("臺南市", "中西區", "臺南市中西區民生路8鄰5號", "street")
    assert (got["c2"]["city"], got["c2"]["address_precision"]) == ("臺東縣", "city") and "lat" not in got["c2"] and "category_raw" not in got["c2"]
    assert "address" not in got["c3"] and got["c3"]["entity_kind"] == "heritage"


def test_points_of_the_culture_map(spark, tmp_path):
    rows = [
        {"_typeId": "N", "mainTypePk": "7", "name": "乙工坊", "groupTypeName": "", "cityName": "臺南市", "address": "民生路1號", "latitude": "120.2", "longitude": "22.9", "hitRate": 3},
        {"_typeId": "N", "mainTypePk": "7", "name": "甲工坊", "groupTypeName": "工坊", "cityName": "", "address": "台北市中正區中山南路21號", "latitude": "35.9", "longitude": "139.6"},
        {"_typeId": "A", "mainTypePk": "8", "name": "古厝", "representImage": "http://i", "latitude": "23", "longitude": "0"}, {"_typeId": "D", "mainTypePk": "9", "name": "社區"},
    ]
    got = run(spark, tmp_path, "moc-emap-poi", rows)
    assert {k: (v["entity_kind"], v["name"]) for k, v in got.items()} == {"N-7": ("venue", "乙工坊"), "N-7-2": ("venue", "甲工坊"), "A-8": ("heritage", "古厝"), "D-9": ("organization", "社區")}
    assert (got["N-7"]["category_raw"], got["N-7"]["address"], got["N-7"]["lat"], got["N-7"]["lng"], got["N-7"]["popularity"]) == ("工藝工作室", "臺南市民生路1號", 22.9, 120.2, 3.0)
    assert got["N-7-2"]["category_raw"] == "工坊" and got["N-7-2"]["city"] == "臺北市" and "lat" not in got["N-7-2"]
    assert got["A-8"]["category_raw"] == "文化資產" and got["A-8"]["images"][0]["url"] == "http://i" and "lat" not in got["A-8"] and "address" not in got["D-9"]


def test_empty_sources(spark, tmp_path):
    for source in mappings.MAPPINGS:
        assert run(spark, tmp_path, source, []) == {}
