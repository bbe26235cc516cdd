"""Timestamp parsing; every branch is a try-function, so bad text never fails a job.

Python-style ISO text is tried first, then explicit formats in order, then epoch
numbers. All-digit text of nine digits or more is an epoch number, never a date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats accepted beyond ISO, in the order in which they are tried.
WINDOWS_FORMATS = ("yyyy-M-d H:m:s", "M/d/yyyy H:m:s")
GENERIC_FORMATS = ("yyyy-M-d H:m:s", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s", "yyyy/M/d H:m:s")

_MIN_EPOCH = -62135596800.0
_MAX_EPOCH = 253402300799.0


def iso_timestamp(text: Column) -> Column:
    dashed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ].*)?$"), text.try_cast("timestamp"))
    compact_date = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    compact = F.when(text.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
    return F.coalesce(dashed, compact_date, compact)


def epoch_timestamp(text: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e12. Text without a leading digit is not even tried."""
    number = F.when(text.rlike(r"^\s*[+-]?[0-9.]"), text).try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.when(
        seconds.between(_MIN_EPOCH, _MAX_EPOCH), F.timestamp_micros(F.bround(seconds * 1e6, 0).cast("bigint"))
    )


# What makes a time unusable, as the records' messages say it.
DATE_RANGE = "date value out of range"
EPOCH_RANGE = "timestamp out of range for platform time_t"
EPOCH_INFINITE = "cannot convert float infinity to integer"


def iso_error(text: Column) -> Column:
    """Why an ISO time cannot be used: in UTC it lies outside the years 1 to 9999. NULL if it can, or is none.

    Only the first and the last of these years can get there by an offset; other texts are not parsed again.
    """
    year = F.year(iso_timestamp(text))
    return F.when(F.left(text, F.lit(4)).isin("0001", "9999") & ((year < 1) | (year > 9999)), F.lit(DATE_RANGE))


def epoch_error(text: Column) -> Column:
    """Why a number cannot be an epoch time: it does not fit in 64 bits of seconds. NULL if it can, or is no number."""
    infinite = F.lower(F.trim(text)).rlike(r"^[+-]?inf(inity)?$")
    number = F.when(text.rlike(r"^\s*[+-]?[0-9.]"), text).try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    too_large = F.when(F.abs(seconds) >= 2.0**63, F.lit(EPOCH_RANGE))
    # a text with a colon is a time of day and no number
    return F.when(~F.contains(text, F.lit(":")), F.when(infinite | (F.abs(number) == float("inf")), F.lit(EPOCH_INFINITE)).otherwise(too_large))


def _by_formats(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats])


def generic_timestamp(text: Column, ingest_ts: Column) -> Column:
    """CSV times: ISO, four formats, epoch; ``ingest_ts`` where nothing fits."""
    stripped = F.trim(text)
    long_digits = text.rlike(r"^\d{9,}$")
    return F.coalesce(
        F.when(long_digits, epoch_timestamp(text)),
        iso_timestamp(text),
        _by_formats(stripped, GENERIC_FORMATS),
        epoch_timestamp(text),
        ingest_ts,
    )


def windows_timestamp(text: Column, ingest_ts: Column) -> Column:
    """Windows SystemTime; empty text is ``ingest_ts``, unparsable text NULL (kept as ``ts_raw``)."""
    parsed = F.coalesce(iso_timestamp(text), _by_formats(text, WINDOWS_FORMATS))
    return F.when(F.coalesce(text, F.lit("")) == "", ingest_ts).otherwise(parsed)


def syslog_timestamp(text: Column, assumed_year: int, ingest_ts: Column) -> Column:
    """``MMM d HH:mm:ss`` in the assumed year, ISO, or epoch; else ``ingest_ts``."""
    collapsed = F.regexp_replace(text, r"\s+", " ")
    bsd = F.when(
        text.rlike(r"^\w{3}\s"),
        F.try_to_timestamp(F.concat(F.lit(f"{assumed_year} "), collapsed), F.lit("yyyy MMM d HH:mm:ss")),
    )
    epoch = F.when(text.rlike(r"^\d{10,13}(?:\.\d+)?$"), epoch_timestamp(text))
    return F.coalesce(bsd, epoch, iso_timestamp(text), ingest_ts)


def seconds_between(a: Column, b: Column) -> Column:
    """Absolute difference in seconds; NULL when one side is missing."""
    return F.abs(F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text in UTC with a fraction only where there is one."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.coalesce(F.when(micros == 0, whole).otherwise(exact), F.lit(""))
