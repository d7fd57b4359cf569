"""Grounding of normalised temporal expressions: from a string and an anchor date to an inclusive interval of days.

Unresolvable input gives null throughout; the intervals' width rules (356-day years in spans, Monday-to-Monday weeks, the
two-sided single step back) are part of the semantics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The calendar the expressions live in, and the months' names.
FIRST_DAY, LAST_DAY = "1000-01-01", "2030-12-31"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_YMD, _YM, _Y, _DECADE = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}$", r"^\d{4}$", r"^\d{4}s(?:-(early|mid|late))?$"
_SIMPLE = r"^(OFFSET|THIS|NEXT_IMMEDIATE|PREV_IMMEDIATE) P(-?\d+)([DWMY])$"
_SPAN = r"^THIS P(-?\d+)([DWMY]) OFFSET P(-?\d+)\2$"
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where Catalyst would repeat it for every mention inside a CASE."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _interval(start: Column, end: Column) -> Column:
    return let(F.struct(start.alias("start"), end.alias("end")), lambda i: F.when(i["start"].isNotNull() & i["end"].isNotNull(), i))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def day_index(day: Column) -> Column:
    """Days since the calendar's first."""
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def date_kind(e: Column) -> Column:
    """yyyy-mm-dd, yyyy-mm, yyyy, yyyys, or null."""
    first = date_bounds(e)["start"]
    return F.when(first.isNull(), None).when(e.rlike(_YMD), "yyyy-mm-dd").when(e.rlike(_YM), "yyyy-mm").when(e.rlike(_Y), "yyyy").otherwise("yyyys")


def date_bounds(e: Column) -> Column:
    """Plain conditions and casts: Spark compiles them, where it would interpret what stands inside a `let`."""
    year = _int(F.substring(e, 1, 4))
    day = F.when(F.length(e) == 10, e).try_cast("date")  # the cast takes white space at the end
    month = F.concat(e, F.lit("-01")).try_cast("date")
    part = F.regexp_extract(e, _DECADE, 1)
    low = F.when(part == "mid", 4).when(part == "late", 7).otherwise(0)
    high = F.when(part == "early", 3).when(part == "mid", 6).otherwise(9)
    inside = [d.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")) for d in (day, month)]
    first, last = (int(d[:4]) for d in (FIRST_DAY, LAST_DAY))

    def bounds(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))

    return (
        F.when(e.rlike(_YMD), F.when(inside[0], bounds(day, day)))
        .when(e.rlike(_YM), F.when(inside[1], bounds(month, F.last_day(month))))
        .when(e.rlike(_Y), F.when(year.between(first, last), bounds(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))))
        .when(e.rlike(_DECADE), bounds(F.make_date(year + low, F.lit(1), F.lit(1)), F.make_date(year + high, F.lit(12), F.lit(31))))
    )


def offset_kind(e: Column) -> Column:
    """A unit letter after its family: d w m y for points, t* for spans, this*, immediate*; null if the last number is 30 or more."""
    family, unit = F.regexp_extract(e, _SIMPLE, 1), F.lower(F.regexp_extract(e, _SIMPLE, 3))
    last = _int(F.try_element_at(integers(e), F.lit(-1)))
    kind = (
        F.when(e.rlike(_SPAN), F.concat(F.lit("t"), F.lower(F.regexp_extract(e, _SPAN, 2))))
        .when(family == "OFFSET", unit).when(family == "THIS", F.concat(F.lit("this"), unit)).when(family != "", F.concat(F.lit("immediate"), unit))
    )
    return F.when(F.abs(last) < 30, kind)


def integers(e: Column) -> Column:
    return F.regexp_extract_all(e, F.lit(r"(-?\d+)"), F.lit(1))


def week_window(anchor: Column, offset: Column, count: Column) -> Column:
    start = F.date_add(F.date_trunc("week", anchor).cast("date"), 7 * offset)
    return _interval(start, F.date_add(start, 7 * count))


def month_window(anchor: Column, offset: Column, count: Column) -> Column:
    first = F.add_months(anchor, offset)
    return _interval(F.trunc(first, "month"), F.last_day(F.add_months(first, count - 1)))


def year_window(anchor: Column, offset: Column, count: Column) -> Column:
    year = F.year(anchor) + offset
    return _interval(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + count - 1, F.lit(12), F.lit(31)))


def _ordered(a: Column, b: Column) -> Column:
    return _interval(F.least(a, b), F.greatest(a, b))


def offset_bounds(e: Column, anchor: Column) -> Column:
    return F.when(e.contains(" P"), let(offset_kind(e), lambda kind: _of_kind(kind, e, anchor)))


def _of_kind(kind: Column, e: Column, anchor: Column) -> Column:
    n = _int(F.regexp_extract(e, _SIMPLE, 2))
    span = _int(F.regexp_extract(e, _SPAN, 3))
    unit = F.lower(F.right(kind, F.lit(1)))
    point = F.date_add(anchor, n * F.when(unit == "w", 7).when(unit == "m", 30).when(unit == "y", 365).otherwise(1))
    other = F.date_add(anchor, span * F.when(unit == "w", 7).when(unit == "m", 30).when(unit == "y", 356).otherwise(1))
    step = F.when(e.startswith("PREV_IMMEDIATE"), -n).otherwise(n)
    near = F.date_add(anchor, step)
    return (
        F.when(kind.isin("d", "w", "m", "y"), _interval(point, point))
        .when(kind.isin("td", "tw", "tm", "ty"), _ordered(anchor, other))
        .when(kind == "thisd", _interval(F.date_add(anchor, 1 - n), anchor))
        .when(kind == "thisw", week_window(anchor, 1 - n, n))
        .when(kind == "thism", month_window(anchor, 1 - n, n))
        .when(kind == "thisy", year_window(anchor, 1 - n, n))
        .when((kind == "immediated") & (step == 1), _interval(near, near))
        .when(kind == "immediated", _ordered(near, anchor))
        .when(kind == "immediatew", week_window(anchor, step, F.abs(step)))
        .when(kind == "immediatem", month_window(anchor, step, F.abs(step)))
        .when(kind == "immediatey", year_window(anchor, step, F.abs(step)))
    )


def is_reference(e: Column) -> Column:
    return e.isin("PRESENT_REF", "THIS MO", "THIS NI")


def reference_bounds(e: Column, anchor: Column) -> Column:
    return F.when(e.isin("PRESENT_REF", "THIS MO", "THIS NI", "TEV", "TMO", "TNI"), _interval(anchor, anchor))


def interval_bounds(e: Column) -> Column:
    """"a,b": from the first day of a to the last of b."""
    start, end = date_bounds(F.substring_index(e, ",", 1))["start"], date_bounds(F.substring_index(F.substring_index(e, ",", 2), ",", -1))["end"]
    return F.when(e.contains(","), F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))))


def ground(e: Column, anchor: Column) -> Column:
    """Date, offset, reference or interval, in this order: struct<start, end>, or null."""
    return F.coalesce(date_bounds(e), offset_bounds(e, anchor), F.when(is_reference(e), reference_bounds(e, anchor)), interval_bounds(e))


def days_between(i: Column) -> Column:
    """`day_interval` of a column, which it mentions several times."""
    return F.when(i["start"] <= i["end"], F.struct(day_index(i["start"]).alias("a"), day_index(i["end"]).alias("b")))


def day_interval(bounds: Column) -> Column:
    """struct<a, b> of day indices; null if the start is after the end."""
    return let(bounds, days_between)


def month_year_index(text: Column) -> Column:
    """The first "Mon, YYYY" as year * 12 + month - 1."""
    names = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
    pattern = rf"(?i)\b({names})\b,?\s+(\d{{1,4}})\b"
    month = F.lower(F.substring(F.regexp_extract(text, pattern, 1), 1, 3))
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), month)
    return F.when(at > 0, _int(F.regexp_extract(text, pattern, 2)) * 12 + at.cast("int") - 1)


def month_year_date(text: Column) -> Column:
    i = month_year_index(text)
    return F.concat(F.lpad(F.floor(i / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"))


def year_tokens(text: Column) -> Column:
    """Distinct years from 1000 to 2099 that stand as words, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))))


def year_interval(text: Column) -> Column:
    """All years from the first mentioned to the last."""
    y = year_tokens(text)
    return F.when(F.size(y) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.array_min(y), F.array_max(y)))


def question_subtype(question: Column) -> Column:
    # The names of the two kinds of question.
    return F.when(F.lower(question).startswith("what is the time"), "L1_arithmetic").otherwise("L2_time_event")


def tag_years(text: Column) -> Column:
    """The tagger without a server: each distinct year as an expression, array<struct<text, value>>."""
    return F.transform(year_tokens(text), lambda y: F.struct(y.cast("string").alias("text"), y.cast("string").alias("value")))
