"""Small scalar expressions used by the queries and the text sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def gain(fare: Column, tip: Column) -> Column:
    return fare + tip


def profitability(profit: Column, taxis: Column) -> Column:
    return profit / taxis


def window_end_ms(window: Column) -> Column:
    """End of a `window` struct as epoch milliseconds."""
    return F.unix_millis(window["end"])


def arrival_now() -> Column:
    """Arrival time on a live stream: the clock of the micro-batch."""
    return F.current_timestamp()


def format_ms(ms: Column) -> Column:
    """Epoch milliseconds as local time of the session."""
    return F.date_format(F.timestamp_millis(ms), LOG_TIME_FORMAT)


def tokens(line: Column) -> Column:
    """Comma-separated fields; trailing empty fields do not count."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",")


def number(token: Column) -> Column:
    """A double, or NULL. `NaN` and `Infinity` count only in that exact spelling."""
    trimmed = F.trim(token)
    misspelt = trimmed.rlike("(?i)^[+-]?(inf|infinity|nan)$") & ~trimmed.rlike(
        "^[+-]?(Infinity|NaN)$")
    return F.when(misspelt, None).otherwise(token.try_cast("double"))


def is_date_time(token: Column) -> Column:
    """Six numbers in date-time order.

    Lenient on purpose: month 13, unpadded fields and trailing text are accepted,
    because only the shape of the text decides whether a row is kept.
    """
    return token.rlike(r"^[ \t]*\d+-[ \t]*\d+-[ \t]*\d+ [ \t]*\d+:[ \t]*\d+:[ \t]*\d+")


def date_time(token: Column) -> Column:
    """The timestamp of a well-formed date-time, else NULL."""
    return F.try_to_timestamp(token, F.lit("yyyy-MM-dd HH:mm:ss"))
