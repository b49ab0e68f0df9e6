"""Text shown in report tables."""

from pyspark.sql import Column, functions as F

from voltide.functions.numeric import half_even


def percent_text(x: Column) -> Column:
    """Share as a percent with one decimal and no sign, ``-`` when missing."""
    return F.when(x.isNull(), F.lit("-")).otherwise(F.format_string("%.1f", half_even(x * 100, 1)))


def whole_text(x: Column) -> Column:
    """Whole number as text, ``-`` when missing."""
    return F.coalesce(x.cast("int").cast("string"), F.lit("-"))
