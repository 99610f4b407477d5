"""Time expressions over raw strings; results are timestamp_ntz, null where a text is no time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?$"
MODES = ("before", "through", "through_day", "compact")


def parsed(raw: Column) -> Column:
    """ISO with T or a space, with seconds and fractions or without, or a date alone; a zone suffix is dropped unread."""
    bare = F.regexp_replace(F.trim(raw), r"(Z|[+-]\d\d:?\d\d)$", "")
    return F.when(bare.rlike(ISO), bare.try_cast("timestamp_ntz"))


def whole_seconds(raw: Column) -> Column:
    """As parsed(), but cut at the first full stop, fraction and all that follows it."""
    return parsed(F.substring_index(F.trim(raw), ".", 1))


def minutes_only(raw: Column) -> Column:
    """Only yyyy-MM-dd HH:mm counts."""
    return F.when(raw.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d$"), raw.try_cast("timestamp_ntz"))


def end_of_day(raw: Column) -> Column:
    """A date alone means its last microsecond."""
    is_date = F.trim(raw).rlike(r"^\d{4}-\d\d-\d\d$")
    return F.when(is_date, parsed(raw) + F.expr("interval '23:59:59.999999' hour to second")).otherwise(parsed(raw))


def within(ts: Column, cutoff: Column, mode: str) -> Column:
    """Whether an event counts at the cutoff: `before` strictly; `through` at it too; `through_day` and `compact` as well, and
    they keep what has no time, where the first two drop it."""
    if mode == "before":
        return F.coalesce(ts < cutoff, F.lit(False))
    if mode == "through":
        return F.coalesce(ts <= cutoff, F.lit(False))
    if mode in MODES:
        return ts.isNull() | (ts <= cutoff)
    raise ValueError(f"no such mode: {mode}")


def age_years(born: Column, at: Column) -> Column:
    """Completed years, birthdays in leap years included; null before birth."""
    years = F.year(at) - F.year(born) - (F.date_format(at, "MMdd") < F.date_format(born, "MMdd")).cast("int")
    return F.when(born <= at, years)


def relative(ts: Column, origin: Column) -> Column:
    """`<y>y <d>d <h>h <m>m` since the origin, floored, so that a day earlier is -1y 364d."""
    minutes = F.floor(F.timestamp_diff("MICROSECOND", origin, ts) / 60_000_000)
    days = F.floor(minutes / 1440)
    rest = F.pmod(minutes, F.lit(1440))
    return F.concat(F.floor(days / 365), F.lit("y "), F.pmod(days, F.lit(365)), F.lit("d "), F.floor(rest / 60), F.lit("h "), F.pmod(rest, F.lit(60)), F.lit("m"))


def day_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))


def display(ts: Column) -> Column:
    """The date alone at midnight, else to the minute."""
    at_midnight = F.date_format(ts, "HH:mm:ss") == "00:00:00"
    return F.coalesce(F.when(at_midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm")), F.lit(""))
