"""European option prices and greeks as native column expressions.

``b76`` is the Black-76 model (options on futures), ``bs`` Black-Scholes
(options on stocks). Arguments are columns: s underlying price, k strike,
r yearly rate, t years, v yearly volatility, cp +1 for calls and -1 for puts.
Delta and gamma are scaled to a one percent move, vega to one volatility
point, theta to one of ``annual_days`` days.
"""

from pyspark.sql import Column, functions as F

from voltide import constants as K
from voltide.functions.normal import norm_cdf, norm_pdf

MODELS = ("b76", "bs")


def d1_of(model: str, s, k, r, t, v) -> Column:
    drift = v * v * F.lit(0.5)
    if model == "bs":
        drift = r + drift
    return (F.ln(s / k) + drift * t) / (v * F.sqrt(t))


def price_terms(model, s, k, disc, cp, cdf1, cdf2) -> Column:
    if model == "b76":
        return cp * (s * cdf1 - k * cdf2) * disc
    return cp * (s * cdf1 - k * cdf2 * disc)


def greek_terms(model, s, k, r, t, v, cp, disc, cdf1, cdf2, pdf1, annual_days=K.GREEK_DAYS):
    """Dictionary of the five measures from already computed pieces."""
    carry = disc if model == "b76" else F.lit(1.0)
    root = F.sqrt(t)
    decay = -(s * carry * pdf1 * v / (root * 2)) - cp * r * k * disc * cdf2
    if model == "b76":
        decay = decay + cp * r * s * disc * cdf1
    return {
        "price": price_terms(model, s, k, disc, cp, cdf1, cdf2),
        "delta": cp * carry * cdf1 * s * F.lit(0.01),
        "gamma": carry * pdf1 / (s * v * root) * s * s * F.lit(0.0001),
        "theta": decay / F.lit(float(annual_days)),
        "vega": s * carry * pdf1 * root / F.lit(100.0),
    }


def intrinsic(s: Column, k: Column, cp: Column) -> Column:
    return F.greatest(F.lit(0.0), cp * (s - k))


# volatility that stands in for zero, where the flat value is used anyway
_TINY = 1e-6


def choose(live: Column, value: Column, flat: Column = None) -> Column:
    """``value`` where ``live`` is 1, ``flat`` (or zero) where it is 0.

    Arithmetic instead of CASE, so Spark still finds the subexpressions that
    the five measures share and computes each once.
    """
    return value * live if flat is None else value * live + flat * (F.lit(1.0) - live)


def is_live(v: Column) -> Column:
    return (v > 0).cast("double")


def safe_vol(v: Column) -> Column:
    return F.greatest(v, F.lit(_TINY))


def _pieces(model, s, k, r, t, v, cp):
    w = safe_vol(v)
    d1 = d1_of(model, s, k, r, t, w)
    d2 = d1 - w * F.sqrt(t)
    return w, F.exp(-r * t), norm_cdf(cp * d1), norm_cdf(cp * d2), norm_pdf(d1)


def _price(model, s, k, r, t, v, cp):
    _, disc, cdf1, cdf2, _ = _pieces(model, s, k, r, t, v, cp)
    return choose(is_live(v), price_terms(model, s, k, disc, cp, cdf1, cdf2), intrinsic(s, k, cp))


def measures(terms: dict, s, k, live, cp) -> dict:
    """The five measures with their values at zero volatility."""
    flat = {"price": intrinsic(s, k, cp)}
    return {name: choose(live, col, flat.get(name)) for name, col in terms.items()}


def _greeks(model, s, k, r, t, v, cp, annual_days):
    w, disc, cdf1, cdf2, pdf1 = _pieces(model, s, k, r, t, v, cp)
    terms = greek_terms(model, s, k, r, t, w, cp, disc, cdf1, cdf2, pdf1, annual_days)
    return F.struct(*[col.alias(name) for name, col in measures(terms, s, k, is_live(v), cp).items()])


def b76_price(s, k, r, t, v, cp) -> Column:
    return _price("b76", s, k, r, t, v, cp)


def bs_price(s, k, r, t, v, cp) -> Column:
    return _price("bs", s, k, r, t, v, cp)


def b76_greeks(s, k, r, t, v, cp, annual_days: int = K.GREEK_DAYS) -> Column:
    return _greeks("b76", s, k, r, t, v, cp, annual_days)


def bs_greeks(s, k, r, t, v, cp, annual_days: int = K.GREEK_DAYS) -> Column:
    return _greeks("bs", s, k, r, t, v, cp, annual_days)
