"""Repeating dates: parsing of rules and expansion over a range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of units and weekdays in rules.
UNITS = {"day": "day|days|день|дня|дней", "week": "week|weeks|неделю|недели|недель", "month": "month|months|месяц|месяца|месяцев"}
WEEKDAYS = {0: "mon|monday|пн", 1: "tue|tuesday|вт", 2: "wed|wednesday|ср", 3: "thu|thursday|чт", 4: "fri|friday|пт", 5: "sat|saturday|сб", 6: "sun|sunday|вс"}
EVERY = r"(?:every|кажд\p{L}*)"
#: Steps of a monthly rule at most.
MOST_STEPS = 3650


def _like(words: str) -> Callable[[Column], Column]:
    return lambda name: name.rlike(f"^(?:{words})$")


def parse(rule: Column) -> Column:
    """``unit`` (day, week, month or weekdays; null if not understood), ``step``, ``weekdays`` (Monday 0) and ``until``."""
    r = F.lower(F.trim(rule))
    step = F.coalesce(F.regexp_extract(r, rf"^{EVERY}\s+([0-9]+)\s", 1).try_cast("int"), F.lit(1))
    unit = None
    for name, words in UNITS.items():
        hit = r.rlike(rf"^{EVERY}\s+(?:[0-9]+\s+)?(?:{words})(?:\s|$)")
        unit = F.when(hit, name) if unit is None else unit.when(hit, name)
    named = F.split(F.regexp_extract(r, rf"^{EVERY}\s+([\p{{L}},\s]+?)(?:\s+until.*)?$", 1), r"\s*,\s*")
    numbers = F.array(*(F.when(F.exists(named, _like(words)), k) for k, words in WEEKDAYS.items()))
    days = F.filter(numbers, lambda n: n.isNotNull())
    unit = unit.when(F.size(days) > 0, "weekdays")
    until = F.try_to_date(F.nullif(F.regexp_extract(r, r"until\s+([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))
    return F.struct(unit.alias("unit"), F.greatest(step, F.lit(1)).alias("step"), days.alias("weekdays"), until.alias("until"))


def expand(rule: Column, start: Column, end: Column, until: Column | None = None) -> Column:
    """Dates of a parsed rule from ``start`` to ``end`` or its own end, counted from ``start``.

    Months are added one step after the other, so that the 31st turns into the 28th in
    February and stays there.
    """
    stop = F.least(end, F.coalesce(rule["until"], end), end if until is None else F.coalesce(until, end))
    none = F.array().cast("array<date>")
    daily = F.sequence(start, stop)
    stepped = F.filter(daily, lambda d, i: i % (rule["step"] * F.when(rule["unit"] == "week", 7).otherwise(1)) == 0)
    on_days = F.filter(daily, lambda d: F.array_contains(rule["weekdays"], F.weekday(d)))
    counts = F.sequence(F.lit(1), F.least(F.lit(MOST_STEPS), F.greatest(F.lit(1), F.ceil(F.months_between(stop, start) / rule["step"]).cast("int") + 1)))
    folded = F.aggregate(counts, F.array(start), lambda s, _: F.concat(s, F.array(F.add_months(F.element_at(s, -1), rule["step"]))))
    months = F.filter(folded, lambda d: d <= stop)
    found = F.when(rule["unit"] == "month", months).when(rule["unit"] == "weekdays", on_days).when(rule["unit"].isin("day", "week"), stepped)
    return F.when(start > stop, none).otherwise(F.coalesce(found, none))


def following(rule: Column, after: Column, within: int = 400) -> Column:
    """The first date that the rule gives when counted from the day after; null beyond its end."""
    return F.get(expand(rule, F.date_add(after, 1), F.date_add(after, within)), F.lit(0))
