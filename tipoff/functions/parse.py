"""Display text to typed columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date forms and their defaults.
FULL_DATE = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:\s+(\d{2}):(\d{2}))?"
DAY_AND_TIME = r"^(\d{1,2})\.(\d{1,2})\.\s*(\d{2}):(\d{2})"
DAY_ONLY = r"^(\d{1,2})\.(\d{1,2})\."
SEASON_SLUG = r"-(\d{4})-(\d{4})/"
DEFAULT_HOUR = 12
LOOKBACK_DAYS = 540
SEASON_FIRST_MONTH = 7


def _part(text: Column, pattern: str, group: int) -> Column:
    # a cast that fails costs an exception, so text without a match is made NULL before
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.to_date(F.try_make_timestamp(year, month, day, zero, zero, zero))


def recent_date(month: Column, day: Column, today: dt.date) -> Column:
    """Latest past date with that day and month, this year or last, within the look-back."""
    anchor = F.lit(today)

    def in_year(year: int) -> Column:
        d = _date(F.lit(year), month, day)
        return F.when((d <= anchor) & (F.datediff(anchor, d) <= LOOKBACK_DAYS), d)

    return F.coalesce(in_year(today.year), in_year(today.year - 1))


def listing_timestamp(text: Column, today: dt.date) -> Column:
    """``DD.MM.YYYY [HH:MM]``, ``DD.MM. HH:MM`` or ``DD.MM.``; noon when no time is given."""
    s = F.trim(text)
    zero, noon = F.lit(0), F.lit(DEFAULT_HOUR)
    full = F.try_make_timestamp(
        _part(s, FULL_DATE, 3),
        _part(s, FULL_DATE, 2),
        _part(s, FULL_DATE, 1),
        F.coalesce(_part(s, FULL_DATE, 4), noon),
        F.coalesce(_part(s, FULL_DATE, 5), zero),
        zero,
    )

    def dated(pattern: str, hour: Column, minute: Column) -> Column:
        d = recent_date(_part(s, pattern, 2), _part(s, pattern, 1), today)
        return F.try_make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), hour, minute, zero)

    return (
        F.when(s.rlike(FULL_DATE), full)
        .when(
            s.rlike(DAY_AND_TIME),
            dated(DAY_AND_TIME, _part(s, DAY_AND_TIME, 3), _part(s, DAY_AND_TIME, 4)),
        )
        .when(s.rlike(DAY_ONLY), dated(DAY_ONLY, noon, zero))
    )


def season_years(url: Column) -> tuple[Column, Column]:
    """First and second year of a ``...-2024-2025/`` slug, NULL without one."""
    return _part(url, SEASON_SLUG, 1), _part(url, SEASON_SLUG, 2)


def listing_date(text: Column, url: Column, today: dt.date) -> Column:
    """Date of a year-less listing row; the season slug decides the year when there is one."""
    s = F.trim(text)
    day, month = _part(s, DAY_ONLY, 1), _part(s, DAY_ONLY, 2)
    first, second = season_years(url)
    seasonal = _date(F.when(month >= SEASON_FIRST_MONTH, first).otherwise(second), month, day)
    return F.when(first.isNotNull(), seasonal).otherwise(recent_date(month, day, today))


def _int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def integer(text: Column) -> Column:
    """Whole number or NULL; surrounding blanks are fine, decimals are not."""
    return F.when(F.trim(text.cast("string")).rlike(r"^[+-]?\d+$"), _int(text.cast("string")))


def count_of(text: Column) -> Column:
    """Non-negative whole number or NULL."""
    n = integer(text)
    return F.when(n >= 0, n)


LENIENT_SHOT = r"^\s*([+-]?\d+)\s*/\s*([+-]?\d+)\(*(?=\s|/|$)"
ATTEMPTS_AFTER_SLASH = r"^[^/]*/\s*([+-]?\d+)(?=\s|/|$)"
STRICT_SHOT = r"^([+-]?\d+)/([+-]?\d+)$"


def shot_lenient(text: Column) -> tuple[Column, Column]:
    """(made, attempted); (0, 0) when the text does not parse."""
    return tuple(F.coalesce(_part(text, LENIENT_SHOT, i), F.lit(0)) for i in (1, 2))


def shot_attempts(text: Column) -> Column:
    """Attempts of ``made/attempted`` or of a plain number; NULL when neither."""
    return F.when(F.contains(text, F.lit("/")), _part(text, ATTEMPTS_AFTER_SLASH, 1)).otherwise(
        integer(text)
    )


def shot_strict(text: Column) -> tuple[Column, Column]:
    """(made, attempted), both NULL unless 0 <= made <= attempted."""
    bare = F.replace(F.substring_index(F.trim(text), "(", 1), F.lit(" "), F.lit(""))
    # arguments of a lambda are evaluated once, where columns would be parsed again in every place
    read = F.transform(
        F.array(bare),
        lambda b: F.struct(_part(b, STRICT_SHOT, 1).alias("made"), _part(b, STRICT_SHOT, 2).alias("tried")),
    )
    good = F.get(F.filter(read, lambda p: (p["made"] >= 0) & (p["tried"] >= 0) & (p["made"] <= p["tried"])), F.lit(0))
    return good["made"], good["tried"]


def status_of(text: Column, mapping: dict[str, str], default: str = "FINISHED") -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.lit(default))


def event_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
