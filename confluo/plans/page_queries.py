"""Predicates and scores of pages, on records rendered from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates
from ..operators import state
from .registry import query, table

NOTES = ["【節目取消公告】", "（取消）", "( 人數不足取消 ）", "【10/24 延期】", "停演 延期通知", "取消"]
STATUS = "CASE item_id % 11 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'postponed' WHEN 2 THEN 'open' END"


@query("p03_title_status", f"""SELECT item_id, CASE WHEN item_id % 11 = 0 OR item_id % 7 IN (0, 1, 2, 4) THEN 'cancelled' WHEN item_id % 11 = 1 OR item_id % 7 = 3 THEN 'postponed' END AS status FROM items""")
def title_status(spark, sf_dir):
    """What sources say in the status or only in the title."""
    items = table(spark, sf_dir, "items")
    title = F.concat(F.coalesce("name", F.lit("")), F.coalesce(F.get(F.array(*map(F.lit, NOTES)), (F.col("item_id") % 7).cast("int")), F.lit("")))
    rows = items.select("item_id", F.expr(STATUS).alias("s"), title.alias("t"))
    found = F.when(predicates.is_cancelled(F.col("s"), F.col("t")), "cancelled").when(predicates.is_postponed(F.col("s"), F.col("t")), "postponed")
    return rows.select("item_id", found.alias("status"))


@query("p06_venue_labels", "SELECT client_id, CASE client_id % 6 WHEN 0 THEN '館' || client_id WHEN 5 THEN '大安區（臺北市）' || client_id END AS venue FROM clients")
def venue_labels(spark, sf_dir):
    """Names, and what stands in their place: a web address, the title, a district with its city, nothing."""
    k = F.col("client_id").cast("string")
    title = F.concat(F.lit("展覽"), k)
    forms = F.array(F.concat(F.lit(" 館"), k), F.concat(F.lit("HTTPS://x.org/"), k), F.concat(title, F.lit(" ")), F.lit("金沙鎮（金門縣） ="), F.lit(" "), F.concat(F.lit("大安區（臺北市）"), k))
    return table(spark, sf_dir, "clients").select("client_id", predicates.venue_label(F.get(forms, (F.col("client_id") % 6).cast("int")), title).alias("venue"))


VISIT = ["CASE WHEN client_id % 5 = 0 THEN segment END", "CASE WHEN client_id % 7 = 0 THEN client_id % 2 = 0 END", "client_id % 11 = 0", "CASE client_id % 13 WHEN 0 THEN '部分開放參觀' WHEN 1 THEN '不開放參觀' WHEN 2 THEN '' END"]


@query("p08_visit_info", f"SELECT client_id, coalesce(({VISIT[0]}) <> '', false) OR ({VISIT[1]}) IS NOT NULL OR {VISIT[2]} OR client_id % 13 = 0 AS visit FROM clients")
def visit_info(spark, sf_dir):
    return table(spark, sf_dir, "clients").select("client_id", predicates.has_visit_info(*(F.expr(v) for v in VISIT)).alias("visit"))


#: A page for every client: its kind, and its facts by columns, in words that both engines understand.
FACTS = {
    "kind": "CASE client_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'venue' ELSE 'heritage' END", "title": "coalesce(name, '')", "venue": "CASE WHEN client_id % 2 = 0 THEN city END", "description": "CASE WHEN client_id % 4 > 0 THEN segment END", "city": "city",
    "district": "CASE WHEN client_id % 5 > 0 THEN city END", "lat": "CASE WHEN client_id % 7 > 1 THEN balance END", "precision": "CASE client_id % 6 WHEN 0 THEN 'street' WHEN 1 THEN 'city' END", "category": "segment", "sessions": "client_id % 4", "sources": "client_id % 3",
    "images": "client_id % 2", "days_ago": "client_id % 300 - 60", "impressions": "CASE WHEN client_id % 10 > 3 THEN client_id % 20 END", "events": "client_id % 40", "registry": "source = 'crm'", "hours": "CASE WHEN client_id % 8 = 0 THEN segment END",
    "history": "CASE WHEN client_id % 9 > 2 THEN repeat('x', CAST(client_id % 1500 AS INTEGER)) END", "level": "CASE WHEN client_id % 3 = 2 AND client_id % 2 = 0 THEN 'a' END",
}


def _points(*rules: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {points} ELSE 0 END" for rule, points in rules)


THIN = "description IS NULL AND images = 0 AND lat IS NULL AND NOT coalesce(precision = 'street', false)"
EVENT = _points(
    ("length(title) >= 6", 1), ("venue IS NOT NULL", 1), ("description IS NOT NULL", 2), ("city IS NOT NULL", 1), ("district IS NOT NULL", 0.5), ("lat IS NOT NULL", 1), ("precision = 'street'", 1), ("category IS NOT NULL", 0.5), ("sessions > 1", 0.5),
    ("sources > 1", 1), ("images > 0", 0.5), ("days_ago > 60 AND NOT (days_ago <= 180 AND coalesce(impressions, 0) >= 10)", -4), (THIN, -1))
VENUE = _points(
    ("events >= 1", 2), ("events >= 5", 2), ("events >= 20", 1), ("lat IS NOT NULL", 1), ("precision = 'street'", 1.5), ("city IS NOT NULL AND NOT coalesce(precision = 'street', false)", 0.5), ("description IS NOT NULL", 1), ("registry", 0.5), ("hours IS NOT NULL", 1))
HERITAGE = _points(("history IS NOT NULL", 3), ("length(history) >= 1000", 1), ("lat IS NOT NULL", 1), ("precision = 'street'", 1), ("level IS NOT NULL", 1), ("images > 0", 0.5))


@query("x01_page_rubrics", f"WITH p AS (SELECT client_id, {', '.join(f'{v} AS {k}' for k, v in FACTS.items())} FROM clients) SELECT client_id, CAST(CASE kind WHEN 'event' THEN {EVENT} WHEN 'venue' THEN {VENUE} ELSE {HERITAGE} END AS DOUBLE) AS score FROM p")
def page_rubrics(spark, sf_dir):
    """The three rubrics over pages of three kinds."""
    pages = table(spark, sf_dir, "clients").selectExpr("client_id", *(f"{v.replace('INTEGER', 'INT')} as {k}" for k, v in FACTS.items()))
    today = F.lit("2024-06-01").cast("date")
    c = {k: F.col(k) for k in FACTS} | {"thin": F.expr(THIN), "end": F.date_sub(today, F.col("days_ago").cast("int"))}
    score = F.when(F.col("kind") == "event", state.event_score(c, today)).when(F.col("kind") == "venue", state.venue_score(c)).otherwise(state.heritage_score(c))
    return pages.select("client_id", score.alias("score"))
