"""Opening hours: text in a strict grammar to array<struct<days, opens, closes>>, null when any part does not fit.

Every line is cut into tokens and must be one of three sentences: days and times, times alone, or days that are closed.
Times alone hold for the days that no other line names, and only where some line says when it is closed. A wrong time is
worse than none, so a word that the grammar does not know makes the whole text null.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = "array<struct<days: array<string>, opens: string, closes: string>>"
# Week days, spellings, and the words that may stand in a line about closed days.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HAN_DAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
SPELLINGS = {"週": "周|星期|禮拜", "-": "[～~〜－—–]", ":": "：", "": "\r", " ": "[ \t　]+"}
CLOSED = "休館日?|公休|不開放|閉館"
HOLIDAYS = "國定假日|民俗節日|春節|除夕|選舉日"
EVERY = "每週|每逢|逢"
TOKENS = {
    "time": r"\d{1,2}:\d{2}", "holiday": HOLIDAYS, "closed": CLOSED, "every": EVERY, "weekday": "週[一二三四五六日天]", "to": "[-至到]", "and": "[.、,，與和及]", "filler": "[:暨以為]", "bare": "[一二三四五六日天]",
}
_TOKEN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in TOKENS.items()) + r"|(?P<other>\S)")
_LINE_END = re.compile("[\n;；。]")
_BULLET = re.compile(r"^\s*(?:\d+[.、]|[■※*・])\s*")


class _Line:
    """The tokens of a line and a place in them."""

    def __init__(self, line: str):
        self.tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(line)]
        self.at = 0

    def kind(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def days(self) -> list[int] | None:
        """One day, or a range of days that does not run backwards."""
        first = last = HAN_DAYS[self.take()[-1]]
        if self.kind() == "to" and self.kind(1) in ("weekday", "bare"):
            self.take()
            last = HAN_DAYS[self.take()[-1]]
        return list(range(first, last + 1)) or None

    def spans(self) -> list[tuple[str, str]] | None:
        """One or two times from - to up to the end of the line, in order."""
        found: list[tuple[str, str]] = []
        while [self.kind(k) for k in range(3)] == ["time", "to", "time"]:
            opens, _, closes = (self.take().rjust(5, "0") for _ in range(3))
            if not (opens < closes <= "24:00") or (found and opens < found[-1][1]):
                return None
            found.append((opens, closes))
            if len(found) < 2 and self.kind() == "and" and self.tokens[self.at][1] in ".、,，" and self.kind(1) == "time":
                self.take()
        return found if found and self.kind() is None else None


def _closed(line: _Line) -> set[int] | None:
    days: set[int] = set()
    while line.kind():
        if line.kind() == "weekday":
            days.update(line.days() or [])
        elif line.kind() in ("closed", "holiday", "every", "and", "filler"):
            line.take()
        else:
            return None
    return days


def _open(line: _Line) -> tuple[list[int], list[tuple[str, str]]] | None:
    """The days of a line (none: not said) and its times."""
    days: list[int] = []
    if line.kind() == "weekday":
        while line.kind() in ("weekday", "bare"):
            own = line.days()
            if own is None:
                return None
            days += own
            if line.kind() == "and" and line.kind(1) in ("weekday", "bare"):
                line.take()
            else:
                break
        if line.kind() == "filler" and line.tokens[line.at][1] == ":":
            line.take()
    spans = line.spans()
    return None if spans is None else (days, spans)


def parse_hours(text: str | None) -> list[dict] | None:
    s = text or ""
    for plain, spelling in SPELLINGS.items():
        s = re.sub(spelling, plain, s)
    lines = [x for x in (_BULLET.sub("", part).strip() for part in _LINE_END.split(s)) if x]
    hours: dict[int, list[tuple[str, str]]] = {}
    others: list[tuple[str, str]] | None = None
    closed: set[int] = set()
    for line in map(_Line, lines):
        if any(kind == "closed" for kind, _ in line.tokens):
            days = _closed(line)
            if days is None:
                return None
            closed |= days
            continue
        found = _open(line)
        if found is None or (not found[0] and others is not None):
            return None
        if found[0]:
            hours.update(dict.fromkeys(found[0], found[1]))
        else:
            others = found[1]
    if others is not None:
        if not closed:
            return None
        hours = {d: hours.get(d, others) for d in range(7)}
    groups: dict[tuple[str, str], list[str]] = {}
    for d in range(7):
        for span in hours.get(d, []) if d not in closed else []:
            groups.setdefault(span, []).append(DAYS[d])
    return [{"days": days, "opens": a, "closes": b} for (a, b), days in groups.items()] or None


@functools.lru_cache(maxsize=1)
def _udf():
    return F.pandas_udf(lambda s: s.map(parse_hours), HOURS)


def parse_opening_hours(text: Column) -> Column:
    return _udf()(text)
