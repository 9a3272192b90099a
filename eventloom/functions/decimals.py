"""Doubles in decimal places, rounded on their exact binary value, ties to even: what C's printf prints.

Spark's own format rounds the shortest decimal that stands for a double, half up: 2.25 and 0.15 to 2.3 and 0.2, where the
exact values give 2.2 and 0.1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on a double is a whole number.
WHOLE = float(1 << 52)
PLACES = 6
#: Splits a double into two halves whose products are exact.
HALVING = float((1 << 27) + 1)
#: Doubles above this have more digits than a decimal.
MOST = 1e38


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it: code would grow with its repetitions."""
    return F.transform(F.array(value), body)[0]


def _units(fraction: Column, odd: Column, places: int) -> Column:
    """`fraction`, in [0, 1), in units of the last place; of a tie the even one, for no places that of an even whole part."""
    scale = 10.0**places

    def told(f: Column, high: Column, product: Column) -> Column:
        low = f - high
        # What the product lacks of fraction * scale, exactly: the scale has few bits.
        rest = (high * scale - product) + low * scale
        base = F.floor(product)
        over = (product - base.cast("double") - 0.5) + rest
        up = (over > 0) | ((over == 0) & (F.pmod(base, F.lit(2)) == 1 if places else odd))
        return base + F.when(up, 1).otherwise(0)

    return let(fraction, lambda f: let(f * HALVING, lambda t: let(t - (t - f), lambda high: let(f * scale, lambda product: told(f, high, product)))))


def _padded(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _whole(size: Column) -> Column:
    """The digits of a whole double up to MOST, in parts of 52 bits, which are exact as decimals."""
    part = F.lit(1 << 52).cast("decimal(16,0)")

    def told(top: Column) -> Column:
        rest = size - top.cast("double") * (WHOLE * WHOLE)
        mid = F.floor(rest / WHOLE)
        low = rest - mid.cast("double") * WHOLE
        above = ((top.cast("decimal(8,0)") * part).cast("decimal(23,0)") + mid.cast("decimal(16,0)")).cast("decimal(23,0)")
        return ((above * part).cast("decimal(38,0)") + low.cast("decimal(16,0)")).cast("decimal(38,0)").cast("string")

    return F.when(size < 9e18, size.cast("long").cast("string")).otherwise(let(F.floor(size / (WHOLE * WHOLE)), told))


def fixed(value: Column, places: int = 0, width: int = 0) -> Column:
    """`value` with `places` decimals (at most 6), filled with spaces up to `width` on the left, as C prints `%w.pf`.

    Null stays null; nan, inf and -inf are told so; a negative value that rounds to nothing keeps its sign. Values above 1e38 are
    told by their shortest digits.
    """
    if not 0 <= places <= PLACES:
        raise ValueError(f"0 to {PLACES} places")
    unit = 10**places

    def small(size: Column) -> Column:
        def told(whole: Column) -> Column:
            units = _units(size - whole.cast("double"), F.pmod(whole, F.lit(2)) == 1, places)
            if not places:
                return (whole + units).cast("string")
            return let(units, lambda u: F.concat((whole + F.floor(u / unit)).cast("string"), F.lit("."), F.lpad((u % unit).cast("string"), places, "0")))

        return let(F.floor(size), told)

    def told(x: Column) -> Column:
        size = F.abs(x)
        zeros = "." + "0" * places if places else ""
        large = F.concat(F.when(size < MOST, _whole(size)).otherwise(F.format_string("%.0f", size)), F.lit(zeros))
        # -0.0 is told from 0.0 by its text.
        sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
        text = F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size < WHOLE, F.concat(sign, small(size))).otherwise(F.concat(sign, large))
        return let(text, lambda t: _padded(t, width)) if width else text

    x = value.cast("double")
    # Between these sizes the shortest decimal is written plainly, and rounds as the exact value does unless it ends in a 5
    # just behind the last place: then, and outside, the exact value is looked at.
    plain = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7) & ~x.cast("string").rlike(rf"\.\d{{{places}}}50*$")
    return F.when(plain, F.format_string(f"%{width or ''}.{places}f", x)).otherwise(let(x, lambda v: F.when(v.isNotNull(), told(v))))


def rounded(value: Column, places: int = 0) -> Column:
    """The double nearest to `value` rounded to `places` decimals, on its exact value, ties to even."""
    return fixed(value, places).cast("double")
