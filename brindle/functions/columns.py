"""Functions whose plain Spark counterparts differ, as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dialect import _STRFTIME


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat(*cols: Column | str) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *map(_c, cols))


def regexp_replace(c: Column | str, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match, or all with flag g; i ignores case."""
    c, pattern = _c(c), ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(c, pattern, replacement)
    m = F.regexp_extract(c, pattern, 0)
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(c.rlike(pattern), F.concat(F.substring(c, F.lit(1), at - 1), F.regexp_replace(m, pattern, replacement), F.substring(c, at + F.length(m), F.length(c)))).otherwise(c)


def string_split(c: Column | str, delimiter: str) -> Column:
    """By a literal delimiter."""
    return F.split(_c(c), "\\Q" + delimiter + "\\E")


def left(c: Column | str, n: int) -> Column:
    """A negative n drops characters at the other end."""
    c = _c(c)
    return F.left(c, F.lit(n)) if n >= 0 else F.left(c, F.greatest(F.length(c) + n, F.lit(0)))


def right(c: Column | str, n: int) -> Column:
    c = _c(c)
    return F.right(c, F.lit(n)) if n >= 0 else F.right(c, F.greatest(F.length(c) + n, F.lit(0)))


def log(c: Column | str) -> Column:
    return F.log10(_c(c))


def date_diff(part: str, a: Column | str, b: Column | str) -> Column:
    """Boundaries of the unit between a and b."""
    a, b = _c(a), _c(b)
    if part.rstrip("s") == "day":
        return F.datediff(b, a).cast("long")
    return F.timestamp_diff(part.rstrip("s").upper(), F.date_trunc(part.rstrip("s"), a), F.date_trunc(part.rstrip("s"), b))


def day_of_week(c: Column | str) -> Column:
    """Sunday is 0."""
    return F.dayofweek(_c(c)) - 1


def strftime(c: Column | str, codes: str) -> Column:
    import re

    return F.date_format(_c(c), re.sub(r"%-?[a-zA-Z%]", lambda m: _STRFTIME[m[0]], codes))


def epoch(c: Column | str) -> Column:
    return F.unix_micros(_c(c).cast("timestamp")) / 1e6


def to_int(c: Column | str, kind: str = "int") -> Column:
    """Fractions round half away from zero instead of being cut."""
    return F.round(_c(c).cast("double"), 0).cast(kind)


def divide(a: Column | str, b: Column | str) -> Column:
    """Null for a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def json_string(c: Column | str, path: str) -> Column:
    return F.get_json_object(_c(c), path if path.startswith("$") else "$." + path)


def array_agg(c: Column | str) -> Column:
    """Keeps nulls, which collect_list drops."""
    return F.transform(F.collect_list(F.struct(_c(c).alias("v"))), lambda s: s["v"])


def age(later: Column | str, earlier: Column | str) -> Column:
    """Whole months and the days over."""
    later, earlier = _c(later), _c(earlier)
    months = F.floor(F.months_between(F.date_trunc("day", later), F.date_trunc("day", earlier))).cast("int")
    return F.struct(months.alias("months"), F.datediff(later, F.add_months(earlier, months)).alias("days"))
