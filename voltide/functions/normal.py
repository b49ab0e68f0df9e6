"""Normal distribution as native column expressions.

Spark has no error function. The distribution function is the rational
approximation by Hart in the double-precision form published by G. West
("Better approximations to cumulative normal functions", 2005); its absolute
error is below 1e-15.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values: coefficients of the published approximation ------------------
NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
SPLIT = 7.07106781186547
CUTOFF = 37.0
ROOT_TWO_PI = 2.506628274631
INV_ROOT_TWO_PI = 0.3989422804014327


def norm_pdf(x: Column) -> Column:
    return F.exp(x * x * F.lit(-0.5)) * F.lit(INV_ROOT_TWO_PI)


def norm_cdf(x: Column) -> Column:
    """Distribution function; ``x`` should be a plain column, as it is used often.

    The upper tail is computed once and reflected by arithmetic. A second CASE
    for the sign would double the generated code.
    """
    z = F.abs(x)
    bell = F.exp(x * x * F.lit(-0.5))

    def poly(coefficients):
        return reduce(lambda acc, c: acc * z + F.lit(c), coefficients[1:], F.lit(coefficients[0]))

    fraction = reduce(lambda acc, n: z + F.lit(float(n)) / acc, (4, 3, 2, 1), z + F.lit(0.65))
    upper = (
        F.when(z < SPLIT, bell * poly(NUMERATOR) / poly(DENOMINATOR))
        .when(z <= CUTOFF, bell / fraction / F.lit(ROOT_TWO_PI))
        .when(z > CUTOFF, F.lit(0.0))
    )
    return F.abs((x > 0).cast("double") - upper)


def norm_cdf_sql(x: str) -> str:
    """The same expression as SQL text, for SQL functions."""
    def poly(coefficients):
        return reduce(lambda acc, c: f"({acc} * abs({x}) + {c!r}D)", coefficients[1:], f"{coefficients[0]!r}D")

    fraction = reduce(lambda acc, n: f"(abs({x}) + {n}D / {acc})", (4, 3, 2, 1), f"(abs({x}) + 0.65D)")
    bell = f"exp(-0.5D * {x} * {x})"
    upper = (
        f"(CASE WHEN abs({x}) < {SPLIT}D THEN {bell} * {poly(NUMERATOR)} / {poly(DENOMINATOR)} "
        f"WHEN abs({x}) <= {CUTOFF}D THEN {bell} / {fraction} / {ROOT_TWO_PI}D "
        f"WHEN abs({x}) > {CUTOFF}D THEN 0.0D END)"
    )
    return f"abs(CAST({x} > 0 AS DOUBLE) - {upper})"
