"""Batch pricing of option tables."""

from pyspark.sql import DataFrame, functions as F

from voltide import constants as K
from voltide.functions import european, lattice
from voltide.functions.normal import norm_cdf, norm_pdf

ARGS = ("s", "k", "r", "t", "v", "cp")


def price_options(df: DataFrame, model: str = "crr", greeks: bool = False, args=ARGS, n: int = K.TREE_STEPS,
                  annual_days: int = K.GREEK_DAYS) -> DataFrame:
    """Add ``price`` and, on request, the greeks to a table of contracts.

    ``args`` names the columns (price of the underlying, strike, rate, years,
    volatility, +1 or -1). The European models are computed in steps: each
    step is one projection that uses plain columns of the step before, so the
    generated code stays small enough for the JVM to compile.
    """
    s, k, r, t, v, cp = [F.col(a) for a in args]
    if model == "crr":
        if not greeks:
            return df.withColumn("price", lattice.crr_price(s, k, r, t, v, cp, n))
        out = df.withColumn("_g", lattice.crr_greeks(s, k, r, t, v, cp, n, annual_days))
        kept = [c for c in df.columns if c not in lattice.GREEKS]
        return out.select(*kept, *[F.col(f"_g.{name}").alias(name) for name in lattice.GREEKS])
    if model not in european.MODELS:
        raise ValueError(f"unknown model {model!r}")
    w = european.safe_vol(v)
    one = df.withColumns({
        "_w": w, "_live": european.is_live(v), "_disc": F.exp(-r * t), "_d1": european.d1_of(model, s, k, r, t, w),
    })
    two = one.withColumns({"_z1": cp * F.col("_d1"), "_z2": cp * (F.col("_d1") - F.col("_w") * F.sqrt(t))})
    three = two.withColumns({"_n1": norm_cdf(F.col("_z1")), "_n2": norm_cdf(F.col("_z2"))})
    disc, n1, n2 = F.col("_disc"), F.col("_n1"), F.col("_n2")
    if greeks:
        terms = european.greek_terms(
            model, s, k, r, t, F.col("_w"), cp, disc, n1, n2, norm_pdf(F.col("_d1")), annual_days
        )
    else:
        terms = {"price": european.price_terms(model, s, k, disc, cp, n1, n2)}
    chosen = european.measures(terms, s, k, F.col("_live"), cp)
    kept = [c for c in df.columns if c not in chosen]
    return three.select(*kept, *[col.alias(name) for name, col in chosen.items()])
