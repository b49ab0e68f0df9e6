"""Contract names, ids, dates and flags as column expressions."""

from pyspark.sql import Column, functions as F

from voltide import constants as K


# separates the parts of a matched name; it cannot occur in one
_MARK = "\x01"


def parse_option_name(x: Column, dashed: bool = False) -> Column:
    """Struct (u_id, otype, strike) found anywhere in an option name.

    ``(?U)`` makes ``\\w`` and ``\\d`` cover Unicode, so ids with Chinese
    letters parse. One match per name: its groups replace the whole text, with
    separators, and are split. A name without a match leaves empty groups,
    which become NULL fields.
    """
    pattern = rf"(?Us)^(?:.*?{K.OPTION_NAME_DASHED if dashed else K.OPTION_NAME}.*|.*)\z"
    parts = F.split(F.regexp_replace(x, pattern, _MARK.join(("$1", "$2", "$3"))), _MARK)

    def group(n):
        return F.nullif(F.get(parts, F.lit(n)), F.lit(""))

    return F.struct(group(0).alias("u_id"), group(1).alias("otype"), group(2).try_cast("double").alias("strike"))


def fill_year(year: Column, month: Column, as_of: Column, delta_days: int = K.YEAR_FILL_DAYS) -> Column:
    """First day of a contract month whose year has only one or two digits.

    The year is the latest one, in the decade or century of ``as_of`` +
    ``delta_days`` or the one before, that lies before that day's year.
    """
    horizon = F.year(F.date_add(as_of, delta_days))
    span = F.when(F.length(year) == 2, F.lit(100)).otherwise(F.lit(10))
    digits = year.try_cast("int")
    # the largest year before the horizon that ends in the given digits
    resolved = horizon - 1 - F.pmod(horizon - 1 - digits, span)
    number = month.try_cast("int")
    return F.when(number.between(1, 12), F.make_date(resolved, number, F.lit(1)))


def parse_contract(x: Column, as_of: Column) -> Column:
    """Struct (product, month, otype, strike) of a whole contract name.

    One match per name: the groups are written out with a separator and split.
    A name that does not match stays whole, and all its parts are NULL.
    """
    marked = F.regexp_replace(x, K.CONTRACT_NAME, _MARK.join(f"${n}" for n in (1, 2, 3, 4, 5)))
    parts = F.split(marked, _MARK)

    def part(n):
        return F.get(parts, F.lit(n))

    return F.struct(
        F.when(part(4).isNotNull(), part(0)).alias("product"),
        fill_year(part(1), part(2), as_of).alias("month"),
        F.replace(part(3), F.lit("-"), F.lit("")).alias("otype"),
        part(4).try_cast("double").alias("strike"),
    )


def strip_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\d+", "")


def strip_mark(x: Column, mark: str) -> Column:
    return F.replace(x, F.lit(mark), F.lit(""))


def strip_futures_suffix(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit("_f"), F.lit(""))


def index_underlying(u_id: Column) -> Column:
    """Index options have the equity index itself as their underlying."""
    return F.regexp_replace(u_id, r"IO\d+", K.CSI_GROUP)


def compact_date(x: Column) -> Column:
    """``yyyymmdd`` text to a date."""
    return F.try_to_date(F.trim(x), "yyyyMMdd")


def drop_midnight(x: Column) -> Column:
    """``yyyy-mm-dd 00:00:00`` text to a date."""
    return F.try_to_date(F.replace(F.trim(x), F.lit(" 00:00:00"), F.lit("")), "yyyy-MM-dd")


def is_closed_title(x: Column) -> Column:
    return F.contains(x, F.lit(K.CLOSED_MARK))


def month_day(x: Column) -> Column:
    """Date as month and day digits, the label used in report tables."""
    return F.date_format(x, "MMdd")
