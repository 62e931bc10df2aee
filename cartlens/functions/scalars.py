"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartlens.config import SQL

MONEY = "decimal(18,2)"
_WIDE = "decimal(24,2)"
_COUNT = "decimal(18,0)"


def _time_of_day(ts: Column) -> Column:
    ts = ts.cast("timestamp_ntz")
    return ts - ts.cast("date").cast("timestamp_ntz")


def calendar_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour units between two instants, rounded down also below zero; no time zone involved."""
    short = F.when(_time_of_day(later) < _time_of_day(earlier), 1).otherwise(0)
    return F.datediff(later, earlier) - short


def day_difference(later: Column, earlier: Column, dialect: str) -> Column:
    return calendar_days(later, earlier) if dialect == SQL else elapsed_days(later, earlier)


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def exact_ratio(num: Column, den: Column, digits: int) -> Column:
    """num/den rounded half away from zero on decimals, so no binary fraction decides a tie."""
    quotient = num.cast(_WIDE) / F.nullif(den.cast(_COUNT), F.lit(0).cast(_COUNT))
    return F.round(quotient, digits).cast("double")


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    return exact_ratio(num.cast(_COUNT) * F.lit(100), den, digits)


def plain_ratio(num: Column, den: Column) -> Column:
    """Unrounded division of doubles, null when there is nothing to divide by."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def not_blank(text: Column) -> Column:
    return F.length(F.trim(text, F.lit(" \t\r\n"))) > 0


def hash_below(key: Column, n: int, salt: str = "") -> Column:
    """A whole number in [0, n) fixed by the key alone: 60 bits of its md5."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(n))


def hash_unit(key: Column, salt: str = "") -> Column:
    """A double in [0, 1) fixed by the key alone: 52 bits of its md5."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Short fixed mapping as a literal map; the default answers unknown and null keys."""
    pairs = [part for k, v in mapping.items() for part in (F.lit(k), F.lit(v))]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, default)
