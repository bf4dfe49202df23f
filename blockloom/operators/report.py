"""What the command prints about sizes, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(numerator: Column, denominator: Column, digits: int, width: int) -> Column:
    """A quotient with so many digits behind the point, half to even, padded to a width."""
    exact = numerator.cast("decimal(24,0)") / F.nullif(denominator, F.lit(0)).cast("decimal(14,0)")
    shown = F.bround(exact, digits).cast(f"decimal(24,{digits})").cast("string")
    return F.when(F.length(shown) < width, F.lpad(shown, width, " ")).otherwise(shown)


def summary(before: Column, after: Column) -> Column:
    """The line about one compressed file; without a byte on either side there is nothing to say."""
    line = F.concat(
        fixed(before, after, 3, 6), F.lit(":1, "), fixed(after * 8, before, 3, 6), F.lit(" bits/byte, "),
        fixed((before - after) * 100, before, 2, 5), F.lit("% saved, "), before.cast("string"), F.lit(" in, "), after.cast("string"), F.lit(" out."),
    )
    return F.when((before == 0) | (after == 0), F.lit(" no data compressed.")).otherwise(line)
