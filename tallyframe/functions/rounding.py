"""Rounding as Python does it: of the number that a double exactly is, ties to even.

Spark's own functions round the shortest decimal that reads back as the double, so 2.675, which is a
little less than that, becomes 2.68 there and 2.67 here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fractions are counted in units of 2 to the power of -62, in two longs of 52 and 10 bits. They are whole
#: numbers of units from 2**-10 on; smaller doubles are below any tie at one, two or no digits.
HIGH, LOW, LEAST = 52, 10, 2.0**-10
#: From here on doubles are whole numbers.
WHOLE = 2.0**52


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled(x: Column, digits: int) -> Column:
    """|x| in units of the last digit, rounded to a whole number, as a long; for |x| below WHOLE and at most two digits."""
    if digits not in (0, 1, 2):
        raise ValueError("no, one or two digits")
    by, half = F.lit(10**digits).cast("bigint"), 1 << (HIGH - 1)

    def of_size(size: Column) -> Column:
        whole = F.floor(size).cast("bigint")
        units = (F.when(size < LEAST, 0.0).otherwise(size - whole) * 2.0 ** (HIGH + LOW)).cast("bigint")
        return bound(F.struct(whole.alias("whole"), units.alias("units")), of_units)

    def of_units(u: Column) -> Column:
        low = u["units"].bitwiseAND((1 << LOW) - 1) * by
        high = F.shiftright(u["units"], LOW) * by + F.shiftright(low, LOW)
        last = u["whole"] * by + F.shiftright(high, HIGH)
        parts = F.struct(last.alias("last"), high.bitwiseAND((1 << HIGH) - 1).alias("rest"), low.bitwiseAND((1 << LOW) - 1).alias("rest_low"))
        return bound(parts, of_parts)

    def of_parts(p: Column) -> Column:
        up = (p["rest"] > half) | (p["rest"] == half) & ((p["rest_low"] > 0) | (p["last"] % 2 == 1))
        return p["last"] + up.cast("bigint")

    return bound(F.abs(x), of_size)


def python_round(x: Column, digits: int = 2) -> Column:
    """round(x, digits) of a double column; NaN and infinities stay, and so does null."""
    by = 10**digits

    def of_last(last: Column) -> Column:
        # A whole number that a double may not hold is divided as a decimal.
        return F.when(last < 1 << 53, last.cast("double") / float(by)).otherwise((last.cast("decimal(38,6)") / F.lit(by)).cast("double"))

    def of(x: Column) -> Column:
        rounded = bound(scaled(x, digits), of_last)
        return F.when(_small(x), F.when(_negative(x), -rounded).otherwise(rounded)).otherwise(x)

    return bound(x.cast("double"), of)


def python_fixed(x: Column, digits: int) -> Column:
    """'%.{digits}f' % x of a double column, for values below WHOLE; null for others."""
    by = F.lit(10**digits).cast("bigint")

    def of_last(last: Column) -> Column:
        whole = F.call_function("div", last, by).cast("string")
        return F.concat_ws(".", whole, F.lpad((last % by).cast("string"), digits, "0")) if digits else whole

    def of(x: Column) -> Column:
        return F.when(_small(x), F.concat(F.when(_negative(x), "-").otherwise(""), bound(scaled(x, digits), of_last)))

    return bound(x.cast("double"), of)


def _small(x: Column) -> Column:
    return (F.abs(x) < WHOLE) & ~F.isnan(x)


def _negative(x: Column) -> Column:
    """Also of a zero that has a sign."""
    return x.cast("string").startswith("-")
