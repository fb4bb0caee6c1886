"""Date columns: RFC 822 and ISO 8601 texts to epoch seconds and display dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import blank, trim

_RFC = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?)\s*(.*)$"


def rfc822(c: Column) -> Column:
    """Timestamp of ``Mon, 06 Jul 2026 00:09:01 +0000``; a missing zone is UTC; null if it is none."""
    text = trim(blank(c))
    moment = F.regexp_extract(text, _RFC, 1)
    moment = F.when(moment.rlike(r":\d{2}:\d{2}$"), moment).otherwise(F.concat(moment, F.lit(":00")))
    zone = F.upper(F.trim(F.regexp_extract(text, _RFC, 2)))
    offset = F.when(zone.isin("", "GMT", "UT", "UTC", "Z"), "+0000").when(zone.isin("EST", "CDT"), "-0500").when(zone == "EDT", "-0400").when(zone.isin("CST", "MDT"), "-0600").when(zone.isin("MST", "PDT"), "-0700").when(zone == "PST", "-0800").when(zone.rlike(r"^[+-]\d{4}$"), zone)
    return F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.regexp_replace(moment, r"\s+", " ")), offset), F.lit("d MMM yyyy H:mm:ss Z"))


def published_ts(c: Column, run_ts: Column) -> Column:
    """Epoch seconds; what is not RFC 822 counts as the time of the run."""
    return F.coalesce(F.unix_seconds(rfc822(c)), F.unix_seconds(run_ts))


def iso(c: Column) -> Column:
    """The calendar date of an ISO 8601 text as written; null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(trim(blank(c)), r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1), F.lit("yyyy-MM-dd"))


def display_date(c: Column, months_fa: list[str] = V.MONTHS_FA) -> Column:
    """``day month year`` with Persian month names; else the text up to a plus sign."""
    text = trim(blank(c))
    # the date as written, in its own zone
    day = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\s+\d{1,2}:\d{2}", 1), F.lit("d MMM yyyy"))
    when = F.coalesce(F.when(rfc822(c).isNotNull(), day), iso(c))
    months = F.array(*(F.lit(m) for m in months_fa))
    return F.when(text == "", "").when(when.isNotNull(), F.concat_ws(" ", F.dayofmonth(when), F.element_at(months, F.month(when)), F.year(when))).otherwise(trim(F.substring_index(text, "+", 1)))


def created_at(c: Column) -> Column:
    """A stored creation time: one without an offset, as the first generations wrote it, is in UTC; null if it is no time."""
    s = F.trim(c)
    zoned = s.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, s.try_cast("timestamp")).otherwise(F.concat(s, F.lit("Z")).try_cast("timestamp"))
