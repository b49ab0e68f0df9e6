"""The scalars under SQL names for users who write SQL.

The European formulas become SQL functions, which the optimizer inlines. The
tree needs Arrow batches, so it is registered as a vectorized function.
"""

from pyspark.sql import SparkSession

from voltide import constants as K
from voltide.functions import lattice
from voltide.functions.normal import norm_cdf_sql

_ARGS = "s DOUBLE, k DOUBLE, r DOUBLE, t DOUBLE, v DOUBLE, cp DOUBLE"
_D1_B76 = "((ln(s / k) + 0.5D * v * v * t) / (v * sqrt(t)))"
_D1_BS = "((ln(s / k) + (r + 0.5D * v * v) * t) / (v * sqrt(t)))"


def _price(d1: str, tail_discount: str, lead_discount: str) -> str:
    return (
        "CASE WHEN v <= 0 THEN greatest(0.0D, cp * (s - k)) ELSE "
        f"cp * (s * norm_cdf(cp * {d1}) - k * norm_cdf(cp * ({d1} - v * sqrt(t))){tail_discount}){lead_discount} END"
    )


def register_functions(spark: SparkSession) -> None:
    """Create temporary functions norm_cdf, norm_pdf, b76_price, bs_price,
    crr_price, implied_vol (American) and european_implied_vol."""
    disc = " * exp(-r * t)"
    definitions = {
        "norm_cdf(x DOUBLE)": norm_cdf_sql("x"),
        "norm_pdf(x DOUBLE)": "exp(-0.5D * x * x) * 0.3989422804014327D",
        f"b76_price({_ARGS})": _price(_D1_B76, "", disc),
        f"bs_price({_ARGS})": _price(_D1_BS, disc, ""),
    }
    for head, body in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    spark.udf.register("crr_price", lattice.price_udf(K.TREE_STEPS))
    spark.udf.register("implied_vol", lattice.vol_udf("crr", "newton", K.TREE_STEPS))
    spark.udf.register("european_implied_vol", lattice.vol_udf("b76", "chord", K.TREE_STEPS))
