"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) as Column expressions; they are never cast to a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?(?:Z|[+-]([0-9]{2})(?::?([0-9]{2}))?)?)?)?)?$"
_PDF = r"^(?:D:)?([0-9]{4})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})([0-9]{2})?)?)?)?)?(?:Z.*|[+-].*)?$"
# Fixed value: nothing is dated before this day.
EARLIEST = "1990-01-01"


def _partial(text: Column, pattern: str, limits: tuple[tuple[int, int], ...]) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, k)
    y, m, d = part(1), part(2), part(3)
    fine = F.lit(True)
    for k, most in limits:
        fine = fine & (F.coalesce(part(k).try_cast("int"), F.lit(0)) <= most)
    day = F.try_to_date(F.concat_ws("-", y, F.when(m != "", m).otherwise("01"), F.when(d != "", d).otherwise("01")), "yyyy-MM-dd")
    return F.when((y != "") & fine & day.isNotNull() & (y != "0000"), F.concat_ws("-", y, F.when(m != "", m), F.when(d != "", d)))


def normalise_iso(raw: Column) -> Column:
    return _partial(F.trim(raw), _ISO, ((4, 23), (5, 59), (6, 60), (7, 23), (8, 59)))


def normalise_pdf(raw: Column) -> Column:
    return _partial(F.trim(raw), _PDF, ((4, 23), (5, 59), (6, 60)))


def first_day(partial: Column) -> Column:
    return F.try_to_date(F.concat(partial, F.when(F.length(partial) == 4, "-01-01").when(F.length(partial) == 7, "-01").otherwise("")), "yyyy-MM-dd")


def last_day(partial: Column) -> Column:
    return F.when(F.length(partial) == 4, F.try_to_date(F.concat(partial, F.lit("-12-31")), "yyyy-MM-dd")).when(F.length(partial) == 7, F.last_day(first_day(partial))).otherwise(first_day(partial))


def in_window(partial: Column, access: Column) -> Column:
    """Whether the period overlaps the days from EARLIEST to the access day."""
    return (last_day(partial) >= F.lit(EARLIEST).cast("date")) & (first_day(partial) <= access.cast("date"))


def url_dates(path: Column) -> Column:
    """Every valid /YYYY/MM(/DD)/ date of a URL's path, in order."""
    raw = F.regexp_extract_all(path, F.lit(r"/([0-9]{4}/[0-9]{2}(?:/[0-9]{2})?)(?=/)"), 1)
    return F.filter(F.transform(raw, lambda d: normalise_iso(F.regexp_replace(d, "/", "-"))), lambda d: d.isNotNull())


def years_in(text: Column, first: int = 2015, last: int = 2030) -> Column:
    """Literal four-digit years of the window, in order, duplicates kept."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda y: y.cast("int")), lambda y: (y >= first) & (y <= last))


def run_started_at(run_id: Column) -> Column:
    """The UTC stamp inside a run id; null where there is none."""
    return F.try_to_timestamp(F.regexp_extract(run_id, r"([0-9]{8}T[0-9]{6})Z", 1), F.lit("yyyyMMdd'T'HHmmss"))
