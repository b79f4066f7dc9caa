"""Numbers as text, rounded as C and Python do it: half to even, on the exact binary value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products with small whole numbers are exact.
SPLIT = 134217729.0


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value made once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def fixed(x: Column, digits: int) -> Column:
    """``x`` with a fixed number of decimals, for values below 2**62.

    The part after the point is held against the middle of two neighbouring results by an
    error-free product, so that no rounding happens before the rounding.
    """
    scale = 10**digits

    def parts(v: Column) -> Column:
        whole = F.floor(F.abs(v))
        return F.struct(v.alias("v"), whole.alias("whole"), (F.abs(v) - whole).alias("rest"))

    def split(p: Column) -> Column:
        big = p["rest"] * SPLIT
        return F.struct(p.alias("p"), F.floor(p["rest"] * scale).alias("low"), (big - (big - p["rest"])).alias("high"))

    def steps(s: Column) -> Column:
        above = (s["high"] * (2.0 * scale) - (s["low"] * 2 + 1)) + (s["p"]["rest"] - s["high"]) * (2.0 * scale)
        even = (s["p"]["whole"] * scale + s["low"]) % 2
        return let(above, lambda a: s["low"] + F.when(a > 0, 1).when(a < 0, 0).otherwise(even))

    def text(s: Column, n: Column) -> Column:
        shown = (s["p"]["whole"] + F.floor(n / scale)).cast("string")
        if digits:
            shown = F.concat(shown, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
        return F.concat(F.when(s["p"]["v"] < 0, "-").otherwise(""), shown)

    return let(let(let(x.cast("double"), parts), split), lambda s: let(steps(s), lambda n: text(s, n)))


def signed(x: Column, digits: int) -> Column:
    return let(x, lambda v: F.concat(F.when(v >= 0, "+").otherwise(""), fixed(v, digits)))


def percent(x: Column, digits: int) -> Column:
    return F.concat(fixed(x * 100.0, digits), F.lit("%"))


def short(x: Column, digits: int) -> Column:
    """Rounded, without zeros at the end but for one decimal."""
    return F.regexp_replace(fixed(x, digits), r"(\.\d+?)0+$", "$1")
