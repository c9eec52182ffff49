"""Dates: month arithmetic, epoch conversion, month titles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.regex import java_pattern

# Full month names, and the title pattern of a monthly thread.
MONTH_NAMES = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]
MONTH_TITLE = r"Who(?:'s|\s+is)\s+hiring\??\s*\((\w+)\s+([0-9]{4})\)"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_of(col: Column | str) -> Column:
    """First day of the month, as a date. Truncates the wall clock of NTZ stamps."""
    return F.trunc(_col(col).cast("date"), "month")


def month_label(col: Column | str) -> Column:
    return F.date_format(_col(col), "yyyy-MM")


def to_utc(col: Column | str, data_type: T.DataType | None = None) -> Column:
    """Epoch seconds or ISO text to a timestamp; timestamps pass through.

    Pass the column's type for a typed column; without it the value is read as
    text, which is how a JSON field arrives. Unreadable values give null.
    """
    col = _col(col)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return col
    if isinstance(data_type, (T.IntegralType, T.FractionalType)):
        return F.timestamp_seconds(col)
    text = col.cast("string")
    epoch = text.try_cast("decimal(18,6)")
    return F.when(epoch.isNotNull(), F.timestamp_seconds(epoch)).otherwise(
        text.try_cast("timestamp")
    )


def parse_month_title(col: Column | str) -> Column:
    """``struct<year int, month int>`` named by a thread title, else null.

    Only the first match counts; month names must be full English names.
    """
    col = _col(col)
    # The month name is cut with a pattern but looked up in a constant array.
    pattern = java_pattern(MONTH_TITLE, unicode_words=True)
    name = F.lower(F.regexp_extract(col, pattern, 1))
    number = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTH_NAMES]), name)
    year = F.regexp_extract(col, pattern, 2).try_cast("int")
    return F.when(
        number > 0, F.struct(year.alias("year"), number.cast("int").alias("month"))
    )


def in_months(
    col: Column | str, data_type: T.DataType, start: dt.date, end: dt.date
) -> Column:
    """Stamp within the months of ``start`` through ``end``, as a plain range of the
    raw column, which file scans can use to skip data."""
    after = dt.date(end.year + end.month // 12, end.month % 12 + 1, 1)
    kind, col = data_type.simpleString(), _col(col)
    return (col >= F.lit(start.replace(day=1)).cast(kind)) & (col < F.lit(after).cast(kind))


def months_between_inclusive(start: dt.date, end: dt.date) -> list[dt.date]:
    """First days of all months from ``start`` through ``end``."""
    first = start.year * 12 + start.month - 1
    last = end.year * 12 + end.month - 1
    return [dt.date(n // 12, n % 12 + 1, 1) for n in range(first, last + 1)]


def month_span(start: dt.date, end: dt.date) -> int:
    return (end.year - start.year) * 12 + (end.month - start.month)
