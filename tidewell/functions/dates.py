"""Calendar and circle-of-the-year functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean days of a Gregorian year, the length of the circle.
YEAR = 365.2425


def days_in_year(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def cycle_day(d: Column) -> Column:
    """Place of a date on the circle of the year."""
    return (F.dayofyear(d) - 1) / days_in_year(d) * YEAR


def circular_distance(a: Column, b: Column) -> Column:
    """Days between two places, the short way round."""
    apart = F.pmod(F.abs(a - b), F.lit(YEAR))
    return F.least(apart, F.lit(YEAR) - apart)


def circular_angle(day: Column) -> Column:
    return day * F.lit(2 * 3.141592653589793 / YEAR)


def circular_center(day: Column, weight: Column) -> Column:
    """Aggregate: weighted mean place on the circle; null where the weights cancel out."""
    return angular_center(circular_angle(day), weight)


def angular_center(angle: Column, weight: Column) -> Column:
    """``circular_center`` of angles."""
    s, c = F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle))
    turn = F.atan2(s, c) / F.lit(2 * 3.141592653589793)
    # The fraction of a turn, as SQL has it: just below nought is the end of the year, which pmod would fold to its start.
    return F.when((F.abs(s) < 1e-12) & (F.abs(c) < 1e-12), F.lit(None).cast("double")).otherwise((turn - F.floor(turn)) * F.lit(YEAR))


def rounded(c: Column, places: int) -> Column:
    """A double rounded by its binary value, halves away from nought; ``F.round`` goes by its shortest decimal form."""
    return F.round(c * F.lit(10.0**places)) / F.lit(10.0**places)


def date_on_cycle(year: Column, day: Column) -> Column:
    """The date of a year at a place on the circle (half-even rounding)."""
    start = F.make_date(year, F.lit(1), F.lit(1))
    n = days_in_year(start)
    return F.date_add(start, F.pmod(F.rint(day / YEAR * n).cast("int"), n))


def next_occurrence(as_of: Column, day: Column, half_width: Column) -> Column:
    """The next date at ``day``, unless the window of the one before still covers ``as_of``."""
    y = F.year(as_of)
    this = date_on_cycle(y, day)
    ahead = F.when(this >= as_of, this).otherwise(date_on_cycle(y + 1, day))
    last = F.when(this >= as_of, date_on_cycle(y - 1, day)).otherwise(this)
    return F.when(F.datediff(as_of, last) <= half_width, last).otherwise(ahead)


def days_until(point: Column, now: Column) -> Column:
    """Whole days from now to noon of the point, never negative, halves up."""
    noon = F.unix_micros(F.to_timestamp(F.concat(F.date_format(point, "yyyy-MM-dd"), F.lit(" 12:00:00"))))
    return F.greatest(F.lit(0), F.round((noon - F.unix_micros(now)) / F.lit(86_400_000_000)).cast("int"))


def distance_to_interval(d: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(start, d), F.datediff(d, end))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1, s2) <= F.least(e1, e2)


def parse_timestamp(v: Column) -> Column:
    """Epoch seconds or milliseconds, ISO-8601, or RFC-2822; without a zone it is UTC; else null."""
    # Fixed value: numbers above ten thousand million are milliseconds.
    number = F.when(v.rlike(r"^\d{1,15}$"), v.try_cast("bigint"))
    epoch = F.when(number > 10_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    iso = F.regexp_replace(v, r"Z$", "+00:00")
    mail = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC)$", "+0000")
    tries = [epoch]
    for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"):
        tries.append(F.try_to_timestamp(iso, F.lit(p)))
    tries.append(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(*tries)


def horizon_days(goal: Column) -> Column:
    """'next N days' in a question, between 1 and 365, else 30."""
    n = F.regexp_extract(F.lower(goal), r"next\s+(\d{1,4})\s+days?", 1)
    return F.when(n == "", 30).otherwise(F.least(F.lit(365), F.greatest(F.lit(1), n.cast("int"))))


def window_state(start: Column, end: Column, as_of: Column) -> Column:
    return F.when(as_of < start, "ahead").when(as_of <= end, "expected_ahead").otherwise("expected_passed")
