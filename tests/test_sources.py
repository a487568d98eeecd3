import json
import zipfile

from pyspark.sql import functions as F

from confluo.functions import hours
from confluo.sources import catalogue, connectors, readers, sinks


def test_ndjson_and_missing_files(spark, tmp_path):
    (tmp_path / "src-a.ndjson").write_text('{"id":"a:1"}\n\n{"id":"a:2","entity_kind":"event"}\n', encoding="utf-8")
    rows = readers.read_ndjson(spark, str(tmp_path / "src-a.ndjson"), readers.OBSERVATION).collect()
    assert [(r["id"], r["source"], r["entity_kind"]) for r in rows] == [("a:1", "src-a", None), ("a:2", "src-a", "event")]
    assert readers.read_or_empty(spark, str(tmp_path / "none.ndjson"), readers.OBSERVATION).count() == 0


def test_byte_order_marks(spark, tmp_path):
    (tmp_path / "b.json").write_text('﻿[{"﻿name":"﻿x","n":1}]', encoding="utf-8")
    r = readers.read_json_array(spark, str(tmp_path / "b.json"), "struct<name: string, n: int>").first()
    assert (r["name"], r["n"]) == ("﻿x", 1)


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿name,note,third\n"a ""q"" b","line1\nline2",x\nshort,y\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [tuple(r) for r in rows] == [('a "q" b', "line1\nline2", "x"), ("short", "y", "")]
    assert rows[0].asDict().keys() == {"name", "note", "third"}


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<r><item><name>a</name><n>1</n></item><item><name>b</name><n>2</n></item></r>", encoding="utf-8")
    assert sorted(map(tuple, readers.read_flat_xml(spark, str(tmp_path / "d.xml"), "item", "name string, n int").collect())) == [("a", 1), ("b", 2)]
    feed = spark.createDataFrame([("<rss><item><title><![CDATA[T & t]]></title><link>l</link></item><item><title>U</title>",)], "b string")
    assert feed.select(readers.xml_items(F.col("b"), "item", ["title", "link"]).alias("i")).first()["i"] == [("T & t", "l")]


def test_html_blocks(spark):
    page = spark.createDataFrame([('<li class="e"><b>One</b><i>2026</i></li><li class="e"><b>Two</b></li>',)], "b string")
    found = page.select(readers.html_blocks(F.col("b"), r'(?s)<li class="e">(.*?)</li>', {"name": "<b>(.*?)</b>", "year": "<i>(.*?)</i>"}).alias("x")).first()["x"]
    assert [tuple(r) for r in found] == [("One", "2026"), ("Two", None)]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.json", json.dumps([1]), zipfile.ZIP_DEFLATED)
        z.writestr("b.json", "﻿[2]", zipfile.ZIP_STORED)
        z.writestr("c.txt", "no")
    rows = readers.read_zip_members(spark, str(tmp_path / "z.zip")).collect()
    assert sorted((r["member"], r["body"]) for r in rows) == [("a.json", "[1]"), ("b.json", "[2]")]


def test_catalogue():
    assert len(catalogue.SOURCES) == 79 and len(catalogue.BY_ID) == 79
    kinds = [s.entity for s in catalogue.SOURCES]
    assert [kinds.count(k) for k in ("event", "venue", "person", "organization", "heritage")] == [33, 23, 10, 9, 4]
    assert {s.id for s in catalogue.SOURCES if s.rolling} == {"taipei-gov-hot-events", "nstm-activities", "arte-events", "ncl-events"}
    assert [s.id for s in catalogue.matching("taichung-museums")] == ["taichung-museums"]


def test_connectors_are_isolated(spark, tmp_path):
    (tmp_path / "taichung-museums.json").write_text('[{"id":1,"name":"甲館"},{"id":2,"name":"test"}]', encoding="utf-8")
    one = connectors.Mapping("taichung-museums", F.col("id"), {"name": F.col("name")}, keep=F.col("name") != "test", schema="struct<id: int, name: string>")
    two = connectors.Mapping("cip-museums", F.col("id"), {"name": F.col("name")}, schema="struct<id: int, name: string>")
    rows, failed = connectors.run_all(spark, [one, two], lambda s: str(tmp_path / f"{s}.json"), F.lit("2026-01-01").cast("date"))
    assert [(r["id"], r["entity_kind"], r["name"]) for r in rows.collect()] == [("taichung-museums:1", "venue", "甲館")]
    assert set(failed) == {"cip-museums"}


def test_default_venue(spark):
    venue = {"name": "臺灣戲曲中心", "city": "臺北市", "lat": 25.1, "lng": 121.5, "halls": {"小表演廳": {"lat": 25.2}}}
    kind = "hall string, venue_name_raw string, lat double, lng double, city string, district string, address string"
    halls = [None, "大表演廳", "臺灣戲曲中心大表演廳", "小表演廳", "屏東演藝廳", "國立自然科學博物館"]
    rows = connectors.with_default_venue(spark.createDataFrame([(h, None, None, None, None, None, None) for h in halls], kind), venue).collect()
    got = {r["hall"]: (r["venue_name_raw"], r["city"], r["lat"]) for r in rows}
    assert got[None] == ("臺灣戲曲中心", "臺北市", 25.1) and got["大表演廳"][0] == got["臺灣戲曲中心大表演廳"][0] == "臺灣戲曲中心大表演廳"
    assert got["小表演廳"] == ("臺灣戲曲中心小表演廳", "臺北市", 25.2)
    assert got["屏東演藝廳"] == ("屏東演藝廳", "屏東縣", None) and got["國立自然科學博物館"] == ("國立自然科學博物館", None, None)


def test_quirks(spark):
    df = spark.createDataFrame([("2026-01-01T10:00:00Z", "免費入場", "是")], "m string, p string, t string")
    r = df.select(connectors.wall_clock_shift(F.col("m")), connectors.explicit_free(F.col("p")), connectors.truth(F.col("t"))).first()
    assert tuple(r) == ("2026-01-01T10:00:00+08:00", True, True)
    s = spark.createDataFrame([("2026-01-01T00:00:00+08:00", "2026-01-03T23:59:00+08:00")], "a string, b string").select(connectors.without_sentinel(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert tuple(s) == ("2026-01-01", "2026-01-03")


def test_opening_hours(spark):
    mon, tue, wed, thu, fri, sat, sun = hours.DAYS
    cases = {
        "1.週二至週日:08:00-18:00\n2.週一.國定假日休館": [(hours.DAYS[1:], "08:00", "18:00")],
        "週三、五~日9:00~17:00\n週二、四9:00~19:00": [([tue, thu], "09:00", "19:00"), ([wed, fri, sat, sun], "09:00", "17:00")],
        "週二至週日10：00～18：00": [(hours.DAYS[1:], "10:00", "18:00")],
        "09:00 ~ 17:00\n休館：週一及民俗節日": [(hours.DAYS[1:], "09:00", "17:00")],
        "星期一至星期五 8:30-12:30、13:30-17:30；週六與週日 10:00至16:00": [(hours.DAYS[:5], "08:30", "12:30"), (hours.DAYS[:5], "13:30", "17:30"), ([sat, sun], "10:00", "16:00")],
        "08:30-17:30": None, "每日 09:00-17:00": None, "週六至週二 09:00-17:00": None, "": None, None: None, "依公告": None, "週一至週五 25:00-26:00": None,
        "1.週二至週五:08:00-21:00\n2.週六.週日:08:00-17:00\n3.週一.國定假日.月末週五休館": None, "1.週二:09:00-17:00-僅開放自修室": None, "週六08:00-12:00.12:30-4:30": None,
        "配合演出活動時間開放(春節及保養日不開放)": None,
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", hours.parse_opening_hours(F.col("c")).alias("h")).orderBy("i").collect()
    assert [r["h"] and [(list(x["days"]), x["opens"], x["closes"]) for x in r["h"]] for r in rows] == list(cases.values())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b,", 2, 'q"')], "x string, y int, z string")
    assert [json.loads(r[0]) for r in df.select(sinks.compact_json(["x", "y", "z"])).collect()] == [["a", 1, None], ["b,", 2, 'q"']]
    days = spark.createDataFrame([("s1", "2026-01-01T10:00"), ("s2", "2026-01-02"), ("s3", "bad")], "slug string, start_at string")
    sinks.write_days(days, str(tmp_path / "day"))
    assert sorted(p.name for p in (tmp_path / "day").iterdir() if p.is_dir()) == ["day=2026-01-01", "day=2026-01-02"]
    obs = spark.createDataFrame([("b:1", "b"), ("a:2", "a"), ("a:1", "a")], "id string, source string")
    sinks.write_observations(obs, str(tmp_path / "obs"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "obs" / "source=a")).collect()] == ["a:1", "a:2"]


def test_streams(spark, tmp_path):
    from confluo.streaming import windows

    kind = "ts timestamp, event_type string, user_id long, path string, score double, id string, content_hash string"
    src = tmp_path / "in"
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([(t, "view", 1, "p", 5.0, "a", "h1"), (t + dt.timedelta(minutes=5), "view", 1, "p", 3.5, "b", "h2"), (t + dt.timedelta(hours=5), "click", 2, "q", 4.0, "a", "h1")], kind).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(kind).parquet(str(src))
    for name, df, mode in (("w_counts", windows.counts(stream()), "complete"), ("w_state", windows.hysteresis(stream().select("path", "score", "ts")), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r["event_type"], r["n"]) for r in spark.sql("select * from w_counts").collect()) == [("click", 1), ("view", 2)]
    assert {r["path"]: r["indexable"] for r in spark.sql("select * from w_state").collect()} == {"p": True, "q": False}
    for _ in range(2):
        windows.merged_log(stream().select("id", "content_hash"), str(tmp_path / "log"), str(tmp_path / f"ck{_}")).awaitTermination()
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "log")).distinct().count() == 2
