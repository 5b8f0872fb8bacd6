"""Dates as days since 1900-01-01, ranges and partial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legnet.schema import EPOCH_1900

FIRST_YEAR, LAST_YEAR = 1900, 2078


def days_since_1900(date: Column) -> Column:
    return F.datediff(date, F.lit(EPOCH_1900).cast("date"))


def date_from_days(days: Column) -> Column:
    return F.date_add(F.lit(EPOCH_1900).cast("date"), days)


def decimal_year(date: Column) -> Column:
    """Year plus the elapsed fraction of that year."""
    length = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    return F.year(date) + (F.dayofyear(date) - 1) * (F.lit(1.0) / length)


def mid_date(first: Column, last: Column) -> Column:
    half = (F.datediff(last, first) / 2).cast("int")
    return F.date_add(first, half)


def parse_partial_date(text: Column) -> Column:
    """struct(date1, date2, problem) from '1997', '1997.03', '1997-03-21', ranges.

    A year or month widens to its first and last day; a range is 'a-b' with
    dotted dates or 'a b' with ISO dates; two-digit years are 19xx; a range
    written backwards is turned round and reported.
    """
    one = r"\d+(?:\.\d+){0,2}"
    iso = r"\d+(?:-\d+){0,2}"
    dotted_range = rf"^({one})-({one})$"
    iso_range = rf"^({iso})\s+({iso})$"
    iso_single = r"^\d+-(0?[1-9]|1[0-2])$|^\d+-\d+-\d+$"

    def ends(t):
        """The one or two dates of the text."""
        return (
            F.when(t.rlike(iso_single), F.array(t))
            .when(t.rlike(dotted_range), _groups(t, dotted_range))
            .when(t.rlike(iso_range), _groups(t, iso_range))
            .otherwise(F.array(t))
        )

    def join(e):
        first, last = e[0], F.element_at(e, -1)
        bad = F.coalesce(first["bad"], last["bad"])
        turned = bad.isNull() & (last["hi"] < first["lo"])
        return F.struct(
            F.when(bad.isNull(), F.least(first["lo"], last["hi"])).alias("date1"),
            F.when(bad.isNull(), F.greatest(first["lo"], last["hi"])).alias("date2"),
            F.coalesce(bad, F.when(turned, "range reversed")).alias("problem"),
        )

    dates = _let(F.trim(text), ends)
    return _let(F.transform(F.transform(dates, _parts), _bounds), join)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _groups(text: Column, pattern: str) -> Column:
    return F.array(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def _parts(text: Column) -> Column:
    shape = r"^(\d+)(?:[.-](\d+))?(?:[.-](\d+))?$"
    part = [F.regexp_extract(text, shape, i).try_cast("int") for i in (1, 2, 3)]
    return F.struct(
        F.when(part[0] < 100, part[0] + FIRST_YEAR).otherwise(part[0]).alias("year"),
        part[1].alias("month"),
        part[2].alias("day"),
    )


def _bounds(p: Column) -> Column:
    year, month, day = p["year"], p["month"], p["day"]
    year_ok = year.between(FIRST_YEAR, LAST_YEAR)
    month_ok = month.isNull() | month.between(1, 12)

    def with_month(m):
        # m holds the first day and the last day of the months meant.
        day_ok = day.isNull() | day.between(1, F.dayofmonth(m["closing"]))
        exact = F.date_add(m["opening"], day - 1)
        return F.struct(
            F.coalesce(exact, m["opening"]).alias("lo"),
            F.coalesce(exact, m["closing"]).alias("hi"),
            F.when(year.isNull(), "not a date")
            .when(~year_ok, "invalid year")
            .when(~month_ok, "invalid month")
            .when(~day_ok, "invalid day")
            .alias("bad"),
        )

    fine = year_ok & month_ok
    months = F.struct(
        F.when(fine, F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))).alias("opening"),
        F.when(
            fine, F.last_day(F.make_date(year, F.coalesce(month, F.lit(12)), F.lit(1)))
        ).alias("closing"),
    )
    return _let(months, with_month)
