"""Dates out of text and URLs. A value that is no date falls through to the next pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .text import filled, strip


def _date(text: Column, pattern: str, order: str, day: int | None = None) -> Column:
    """Groups of ``pattern`` in ``order`` (y, m, d) as a date."""
    part = lambda k: F.lpad(F.regexp_extract(text, pattern, order.index(k) + 1), 4 if k == "y" else 2, "0")
    d = F.lit(f"{day:02d}") if day else part("d")
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", part("y"), part("m"), d), "yyyy-MM-dd"))


def in_range(d: Column, start: str = "2015-01-01", end: str = "2025-12-31") -> Column:
    return F.coalesce(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))


def flexible(text: Column) -> Column:
    """ISO first, then D/M/Y, then ``D de mes de Y``, then ``mes [de] Y``.

    Where general parsers read such texts wrongly (month of today, day and month swapped) this gives the date that is meant.
    """
    t = strip(F.lower(filled(text)))
    month = F.create_map(*[x for k, v in L.MONTHS.items() for x in (F.lit(k), F.lit(f"{v:02d}"))])
    long = r"(?U)(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"
    short = r"(?U)(\w+)\s+(?:de\s+)?(\d{4})"
    spoken = F.try_to_date(F.concat_ws("-", F.regexp_extract(t, long, 3), month[F.regexp_extract(t, long, 2)], F.lpad(F.regexp_extract(t, long, 1), 2, "0")), "yyyy-MM-dd")
    only_month = F.try_to_date(F.concat_ws("-", F.regexp_extract(t, short, 2), month[F.regexp_extract(t, short, 1)], F.lit("01")), "yyyy-MM-dd")
    return F.coalesce(
        _date(t, r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd"),
        _date(t, r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", "dmy"),
        F.when(t.rlike(long), spoken),
        F.when(t.rlike(short), only_month),
    )


def _path_end(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")


def of_url(url: Column) -> Column:
    """/Y/M/D/, /Y/M/ (the 15th), Y-M-D, /YYYYMMDD/, or a last /YYYY from 2000 to 2030 (15 June)."""
    u = filled(url)
    last = F.regexp_extract(_path_end(u), r"/(\d{4})$", 1).try_cast("int")
    return F.coalesce(
        _date(u, r"/(\d{4})/(\d{1,2})/(\d{1,2})/", "ymd"),
        _date(u, r"/(\d{4})/(\d{1,2})/", "ymd", 15),
        _date(u, r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
        _date(u, r"/(\d{4})(\d{2})(\d{2})/", "ymd"),
        F.when(last.between(2000, 2030), F.try_to_date(F.concat(last.cast("string"), F.lit("-06-15")), "yyyy-MM-dd")),
    )


def year_of_url(url: Column) -> Column:
    """A plausible year, by five patterns in turn."""
    u = F.regexp_replace(filled(url), "[?#].*$", "")

    def plausible(pattern):
        y, m = (F.regexp_extract(u, pattern, k).try_cast("int") for k in (1, 2))
        return F.when(y.between(2000, 2030) & m.between(1, 12), y)

    def year(text, pattern):
        y = F.regexp_extract(text, pattern, 1).try_cast("int")
        return F.when(y.between(2000, 2030), y)

    return F.coalesce(plausible(r"/(\d{4})/(\d{1,2})/"), plausible(r"/(\d{4})(\d{2})/"), plausible(r"(\d{4})-(\d{2})-\d{2}"), year(u, r"/(\d{4})\d{4}/"), year(_path_end(u), r"/(\d{4})$"))


def year_month(text: Column) -> Column:
    """struct(year, month) of texts; empty where there is none."""
    t = strip(filled(text))
    two = [r"^(\d{4})-(\d{2})", r"^(\d{4})(\d{2})\d{2}", r"^(\d{4})/(\d{2})"]
    found = F.coalesce(
        *[F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).alias("year"), F.regexp_extract(t, p, 2).alias("month"))) for p in two],
        F.struct(F.regexp_extract(t, r"^(\d{4})", 1).alias("year"), F.lit("").alias("month")),
    )
    return found


def social(text: Column) -> Column:
    """``Mon Jan 01 00:00:00 +0000 2024``; the weekday is not read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))


def months_touched(first: Column, last: Column) -> Column:
    """First days of the months from one date to another."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def periods(first: Column, last: Column, days: int) -> Column:
    """(start, end) of consecutive spans of days, the last cut at the end."""
    starts = F.sequence(first, last, F.make_dt_interval(F.lit(days)))
    return F.transform(starts, lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, days - 1), last).alias("end")))


def resolve(*candidates: Column) -> Column:
    """The first that is a date: of the sitemap, the page, the URL."""
    return F.coalesce(*candidates)
