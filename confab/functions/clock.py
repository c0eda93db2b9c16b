"""Clocks and durations as columns.  Rounding is half to even, as in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_INT = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_float(c: Column) -> Column:
    """A number in plain or exponent notation; anything else is null."""
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


def _int(c: Column) -> Column:
    return F.when(c.rlike(_INT), F.trim(c).try_cast("long"))


def parse_clock(c: Column) -> Column:
    """Seconds of ``M:S``, ``H:M:S`` or a plain number, fractions allowed; null if it is none."""
    p = F.split(strip(c), ":", -1)
    at = lambda k: F.get(p, F.lit(k))
    two = _int(at(0)) * 60 + to_float(at(1))
    three = _int(at(0)) * 3600 + _int(at(1)) * 60 + to_float(at(2))
    return F.when(F.size(p) == 2, two).when(F.size(p) == 3, three).otherwise(to_float(strip(c))).cast("double")


def parse_strict_clock(c: Column) -> Column:
    """Whole seconds of ``M:S`` or ``H:M:S``; null otherwise."""
    p = F.split(c, ":", -1)
    at = lambda k: _int(F.get(p, F.lit(k)))
    return F.when(F.size(p) == 2, at(0) * 60 + at(1)).when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + at(2))


def format_clock(c: Column) -> Column:
    """``MM:SS``, with hours in front if there are any; ``--:--`` for null."""
    t = F.greatest(F.bround(c).cast("long"), F.lit(0))
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    short = F.concat_ws(":", two(m), two(s))
    return F.when(c.isNull(), F.lit("--:--")).when(h > 0, F.concat_ws(":", two(h), short)).otherwise(short)


def format_clock_ms(c: Column) -> Column:
    """``MM:SS.mmm`` with any number of minutes; empty for null."""
    t = F.bround(c * 1000).cast("long")
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%02d:%02d.%03d", F.floor(t / 60000), F.floor(t / 1000) % 60, t % 1000))


def format_elapsed(c: Column) -> Column:
    """``1.5s`` below a minute, else ``2m 3s``."""
    t = F.bround(c).cast("long")
    long = F.concat(F.floor(t / 60).cast("string"), F.lit("m "), (t % 60).cast("string"), F.lit("s"))
    return F.when(c < 60, F.concat(F.format_string("%.1f", F.bround(c, 1)), F.lit("s"))).otherwise(long)


def retry_delay(attempt: Column, delays: tuple[int, ...] = (2, 5, 10)) -> Column:
    """Seconds to wait before retry ``attempt`` (from 1); null when there is none left."""
    return F.try_element_at(F.array(*map(F.lit, delays)), attempt.cast("int"))


# How dates and times are written.
DAY, MINUTE, SECOND = "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyyMMdd_HHmmss"


def written_time(at: Column | None, form: str = DAY) -> Column:
    """A point in time in one of the forms above; now if none is given."""
    return F.date_format(F.current_timestamp() if at is None else at, form)
