"""The scalar functions over the keys of a table: each row takes one of the stated texts, and the SQL states what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, geo, hours, text
from ..operators.lifecycle import per_value
from .registry import query, table

Case = tuple[tuple[str | None, ...], str | None]


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, function: Callable[..., Column], *rows: Case, costly: bool = False) -> None:
    """Register ``name``: for every part, the text that the function makes of the case that its key picks.

    Of a costly function each distinct text is worked out once.
    """
    wanted = ", ".join(_sql(want) for _, want in rows)

    @query(name, f"SELECT p_partkey, [{wanted}][p_partkey % {len(rows)} + 1] AS result FROM part")
    def run(spark, sf_dir):
        part = table(spark, sf_dir, "part")
        pick = lambda k: F.get(F.array(*(F.lit(given[k]).cast("string") for given, _ in rows)), F.col("p_partkey") % len(rows))
        given = part.select("p_partkey", *(pick(k).alias(f"c{k}") for k in range(len(rows[0][0]))))
        columns = [f"c{k}" for k in range(len(rows[0][0]))]
        result = function(*map(F.col, columns))
        return (per_value(given, columns, result, "result") if costly else given.withColumn("result", result)).select("p_partkey", "result")


def _json(c: Column) -> Column:
    return F.when(c.isNotNull(), F.to_json(c))


def _point(lat: Column, lng: Column) -> Column:
    p = geo.lat_lng(lat.cast("double"), lng.cast("double"))
    return F.when(p.isNotNull(), F.concat_ws(",", F.format_number(p["lat"], 3), F.format_number(p["lng"], 3)))


def _range(v: Column) -> Column:
    r = dates.parse_date_range(v)
    return F.when(r.isNotNull(), F.concat_ws("/", r["start"]["value"], r["end"]["value"]))


def _hours(v: Column) -> Column:
    found = hours.parse_opening_hours(v)
    shown = F.transform(found, lambda g: F.concat(F.array_join(F.transform(g["days"], lambda d: F.substring(d, 1, 2)), "+"), F.lit(" "), g["opens"], F.lit("-"), g["closes"]))
    return F.array_join(shown, ";")


cases(
    "f02_similar_titles", lambda a, b: text.title_similar(text.norm_title(a), text.norm_title(b)),
    (("古典音樂之夜", "古典音樂之夜"), "exact"), (("古典音樂之夜", "春季古典音樂之夜特輯"), "contains"), (("古典音樂之夜", "完全不同的東西"), None), (("", ""), None), (("音樂", "音樂會"), None), (("ＡＢＣ之夜晚", "abc之夜晚"), "exact"),
)
cases("f08_city", lambda v: geo.normalize_city(v), (("台北市大安區",), "臺北市"), (("高雄縣",), "高雄市"), (("桃園縣中壢市",), "桃園市"), (("somewhere",), None), ((None,), None), (("新北市板橋區",), "新北市"))
cases(
    "f09_address", lambda a, c, d: _json(geo.address_parser({"臺北市": ["大安區", "中正區"], "南投縣": ["魚池鄉"]})(a, c, d)),
    (("106臺北市大安區和平東路一段1號", None, None), '{"city":"臺北市","district":"大安區","address":"臺北市大安區和平東路一段1號","precision":"street"}'),
    (("中山路2號", "臺北市", "中正"), '{"city":"臺北市","district":"中正區","address":"中山路2號","precision":"street"}'),
    (("某某藝廊", None, None), '{"address":"某某藝廊","precision":"venue-name-only"}'), (("", "", ""), "{}"), (("南投縣魚池鄉", None, None), '{"city":"南投縣","district":"魚池鄉","address":"南投縣魚池鄉","precision":"district"}'),
)
cases("f10_lat_lng", _point, (("25.03", "121.5"), "25.030,121.500"), (("121.5", "25.03"), "25.030,121.500"), (("0", "0"), None), ((None, "121"), None))
cases(
    "f16_date_range", _range,
    (("2026-12-11 ~ 2026-12-20",), "2026-12-11/2026-12-20"), (("2026/11/07 14:30~16:00",), "2026-11-07T14:30:00+08:00/2026-11-07T16:00:00+08:00"), (("115-08-01",), "2026-08-01"), (("未定",), None), ((None,), None), costly=True,
)
cases("f17_sentinel_range", lambda a, b: dates.is_sentinel_range(a, b).cast("string"), (("00:00", "23:59"), "true"), (("00:00", "24:00"), "true"), (("10:50", "10:50"), "true"), (("10:00", "12:00"), "false"), ((None, "10:00"), "false"))
cases("f18_ticket_ids", lambda v: _json(text.external_ids(v)), (("https://www.opentix.life/event/123456",), '{"opentix":"123456"}'), (("https://abc.kktix.cc/events/x-1",), '{"kktix":"x-1"}'), (("https://example.org/",), None), ((None,), None))
cases("f20_performers", lambda v: F.to_json(text.split_performers(v)), (("(日本)甲/乙(法國)丙",), '[{"name_raw":"甲","country":"日本"},{"name_raw":"乙","country":"日本"},{"name_raw":"丙","country":"法國"}]'), (("甲、乙",), '[{"name_raw":"甲"},{"name_raw":"乙"}]'), (("",), "[]"))
cases(
    "f23_opening_hours", _hours,
    (("1.週二至週日:08:00-18:00\n2.週一.國定假日休館",), "Tu+We+Th+Fr+Sa+Su 08:00-18:00"), (("週三、五~日9:00~17:00\n週二、四9:00~19:00",), "Tu+Th 09:00-19:00;We+Fr+Sa+Su 09:00-17:00"), (("08:30-17:30",), None), (("週六至週二 09:00-17:00",), None), ((None,), None),
)
cases("f13_norm_url", text.norm_url, (("http//Example.org/a b",), "http://example.org/a b"), (("www.Example.org",), "https://www.example.org/"), (("HTTPS://a.b?x=1",), "https://a.b/?x=1"), (("ftp://a.b",), None), (("https://localhost/",), None), ((None,), None))
cases("f19_strip_tags", text.strip_html, (("<p>a&amp;lt;</p><br>b",), "a&lt;\n\nb"), (("x<b>y</b>&nbsp;",), "xy"), ((None,), ""))
cases("f34_redact_phone", text.redact_phone, (("02-2345678、0912-345-678",), "02-2345678"), (("0912345678",), None), (("0912345678/04-1234567",), "04-1234567"), ((None,), None))
