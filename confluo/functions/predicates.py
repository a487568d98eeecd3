"""What records say of themselves: cancelled or postponed, a label instead of a venue, and whether a place can be visited."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, trim_space

# Words in titles, the one that stands in brackets with blanks around it, and what a place says that is closed.
CANCELLED_WORDS = ["取消公告", "【取消】", "（取消）", "(取消)", "停演"]
CANCELLED_NOTE = "人數不足取消"
POSTPONED_WORD = "延期"
CLOSED_TO_VISITORS = "不開放參觀"
DISTRICT_ENDS, CITY_ENDS = "區鄉鎮市", "縣市"


def _holds(title: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(title, F.lit(w))
    return found


def is_cancelled(status: Column, title: Column) -> Column:
    """By the source's status, or by a notice in the title."""
    title = F.coalesce(title, F.lit(""))
    tight = F.translate(F.regexp_replace(title, f"[{SPACE}]", ""), "（）", "()")
    return F.coalesce(status == "cancelled", F.lit(False)) | _holds(title, CANCELLED_WORDS) | F.contains(tight, F.lit(f"({CANCELLED_NOTE})"))


def is_postponed(status: Column, title: Column) -> Column:
    """By status or title; what is cancelled as well counts as cancelled."""
    said = F.coalesce(status == "postponed", F.lit(False)) | F.contains(F.coalesce(title, F.lit("")), F.lit(POSTPONED_WORD))
    return said & ~is_cancelled(status, title)


def venue_label(name: Column, title: Column) -> Column:
    """A venue's name; null if it is empty, an address on the web, the event's title, or a district with its city in brackets.

    The district has two to four characters before its ending, the city as many, and an equals sign may follow, as sources
    leave it there.
    """
    name = trim_space(name)
    parts = F.split(F.translate(F.regexp_replace(name, rf"[{SPACE}]*=?[{SPACE}]*$", ""), "（）", "()"), "\\(", 2)
    district, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    city = F.when(F.endswith(rest, F.lit(")")), F.substr(rest, F.lit(1), F.length(rest) - 1))
    ends = lambda s, letters: F.contains(F.lit(letters), F.right(s, F.lit(1)))
    han = lambda s: F.rlike(s, F.lit("^[一-鿿]*$"))
    is_district = ends(district, DISTRICT_ENDS) & han(district) & F.length(district).between(3, 5)
    is_city = ends(city, CITY_ENDS) & F.length(city).between(3, 5) & ~F.contains(city, F.lit(")"))
    label = F.coalesce(is_district & is_city, F.lit(False))
    web = F.startswith(F.lower(name), F.lit("http:")) | F.startswith(F.lower(name), F.lit("https:"))
    return F.when((name != "") & ~web & ~label & ~F.coalesce(name == trim_space(title), F.lit(False)), name)


def has_visit_info(opening_hours: Column, is_charge: Column, is_open: Column, open_text: Column) -> Column:
    """Whether a place says when, for how much, or how it can be visited; that it is closed alone says nothing."""
    hours = F.coalesce(opening_hours != "", F.lit(False))
    words = F.coalesce((open_text != "") & (open_text != CLOSED_TO_VISITORS), F.lit(False))
    return hours | is_charge.isNotNull() | F.coalesce(is_open, F.lit(False)) | words
