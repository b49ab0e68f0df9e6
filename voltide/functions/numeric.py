"""Number handling: lenient casts, half-even rounding, NaN clean-up."""

from pyspark.sql import Column, functions as F

_SNAP = 1e9


def half_even(x: Column, scale: int) -> Column:
    """Round half to even at ``scale`` decimals.

    The value is first snapped to nine decimals, so the noise that a
    different summation order leaves in the last bits cannot move a tie.
    ``rint`` stays in primitive doubles; ``bround`` would allocate a decimal
    per row.
    """
    snapped = F.rint(x * F.lit(_SNAP)) / F.lit(_SNAP)
    unit = F.lit(float(10 ** scale))
    return F.rint(snapped * unit) / unit


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def to_numeric(x: Column, kind: str = "double") -> Column:
    """Cast text to a number; a lone dash or nothing is 0, thousands commas go.

    Text that is no number becomes NULL. The dash is replaced before the cast,
    because a failing cast costs far more than the test.
    """
    plain = F.replace(F.trim(x.cast("string")), F.lit(","), F.lit(""))
    filled = F.when(plain.isin("-", ""), F.lit("0")).otherwise(plain)
    if kind == "double":
        return nan_to_null(filled.try_cast("double"))
    return filled.try_cast("decimal(38,6)").try_cast("bigint")


def strict_zero(x: Column) -> Column:
    """Turn the negative zero that rounding may leave into plain zero."""
    return x + F.lit(0.0)
