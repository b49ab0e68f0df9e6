"""Contract expiry, remaining days and implied volatility of option quotes."""

from pyspark.sql import Column, DataFrame, functions as F

from voltide import constants as K
from voltide.functions.lattice import implied_vol
from voltide.functions.text import parse_contract
from voltide.operators import calendar as cal

RULE_SCHEMA = "array<struct<product:string,anchor:string,offset:int,shift:int,valid_from:date,valid_to:date>>"


def expiry_rules() -> Column:
    """The rule table as one constant array column."""
    def text(value):
        return F.lit(value).cast("date")

    return F.array(*[
        F.struct(
            F.lit(product).alias("product"), F.lit(anchor).alias("anchor"), F.lit(offset).alias("offset"),
            F.lit(shift).alias("shift"), text(start).alias("valid_from"), text(end).alias("valid_to"),
        )
        for product, anchor, offset, shift, start, end in K.EXPIRY_RULES
    ])


def expiry_table(calendar: DataFrame) -> DataFrame:
    """Expiry date of every (product, contract month) the calendar covers.

    Built from the calendar and the rules alone, so it needs no pass over the
    quotes, and its size is products times months. Joining it spares the
    quotes a shuffle, because Spark broadcasts it on its own estimate.
    """
    months = calendar.agg(F.min("cal_date").alias("first"), F.max("cal_date").alias("last")).select(
        F.explode(F.sequence(
            F.trunc("first", "month"), F.add_months(F.trunc("last", "month"), 2), F.expr("interval 1 month")
        )).alias("month")
    )
    ruled = months.select("month", F.inline(expiry_rules())).where(
        (F.col("valid_from").isNull() | (F.col("month") >= F.col("valid_from")))
        & (F.col("valid_to").isNull() | (F.col("month") < F.col("valid_to")))
    )
    base = F.add_months("month", F.col("offset"))
    anchored = ruled.select(
        "product",
        "month",
        "shift",
        F.when(F.col("anchor") == "third_friday", cal.third_friday(base))
        .when(F.col("anchor") == "last_weekday", cal.last_weekday(base))
        .otherwise(cal.first_weekday(base)).alias("_anchor"),
    )
    located = cal.nth_session(anchored, "_anchor", "shift", calendar, "expiry")
    return located.select("product", "month", "expiry")


def contract_expiry(df: DataFrame, calendar: DataFrame, product: str = "product", month: str = "month") -> DataFrame:
    table = expiry_table(calendar).select(
        F.col("product").alias(product), F.col("month").alias(month), "expiry"
    )
    return df.join(table, [product, month], "left")


def remaining_days(expiry: Column, trade_date: Column) -> Column:
    """Calendar days up to and including the expiry day; NULL once expired."""
    days = F.datediff(expiry, trade_date) + 1
    return F.when(days > 0, days)


def call_put_sign(otype: Column) -> Column:
    return F.when(otype == "C", F.lit(1.0)).when(otype == "P", F.lit(-1.0))


def route_model(product: Column, routing: str = "crr") -> Column:
    """Model used per product: the American tree for all, or by exercise style."""
    if routing == "crr":
        return F.lit("crr")
    if routing != "by_exercise_style":
        raise ValueError(f"unknown routing {routing!r}")
    return F.when(product.isin(*K.EUROPEAN_GROUPS, *K.EUROPEAN_PRODUCTS), F.lit("b76")).otherwise(F.lit("crr"))


def solve_iv(df: DataFrame, price: str, s: str, k: str, t: str, cp: str, rate: float = K.INTEREST_RATE,
             model: str = "crr", method: str = "chord", out: str = "iv") -> DataFrame:
    """Implied volatility column for any table of quotes."""
    c = F.col
    return df.withColumn(
        out, implied_vol(c(price), c(s), c(k), F.lit(float(rate)), c(t), c(cp), model=model, method=method)
    )


def quote_iv(options: DataFrame, calendar: DataFrame, rate: float = K.INTEREST_RATE, routing: str = "crr") -> DataFrame:
    """Implied volatility, remaining days and status of each option quote.

    The strike and the expiry come from the contract name. Total rows get
    (0, 0). A quote that cannot be solved never stops the job: ``iv_status``
    says why.
    """
    keep = [c for c in options.columns if c not in ("iv", "rdays", "iv_status")]
    total = F.col("product_id") == K.TOTAL_KEY
    parsed = options.select(*keep).withColumn("_c", parse_contract(F.col("product_id"), F.col("trade_date")))
    parsed = parsed.withColumns({
        "_product": F.col("_c.product"),
        "_month": F.col("_c.month"),
        "_k": F.col("_c.strike"),
        "_cp": call_put_sign(F.col("_c.otype")),
    }).drop("_c")
    dated = contract_expiry(parsed, calendar, "_product", "_month")
    ready = dated.withColumn("rdays", remaining_days(F.col("expiry"), F.col("trade_date")))
    products = sorted({rule[0] for rule in K.EXPIRY_RULES})
    gain = F.col("_cp") * (F.col("u_price") - F.col("_k"))
    status = (
        F.when(total, "total")
        .when(F.col("_month").isNull() | F.col("_k").isNull(), "unparsed")
        .when(~F.col("_product").isin(*products), "unsupported_product")
        .when(F.col("expiry").isNull(), "no_calendar")
        .when(F.col("rdays").isNull(), "expired")
        .when(F.col("u_price").isNull() | F.coalesce(F.col("close") <= 0, F.lit(True)), "no_price")
        .when(F.col("close") <= gain, "below_intrinsic")
        .otherwise("ok")
    )
    ready = ready.withColumns({"iv_status": status, "_model": route_model(F.col("_product"), routing)})

    def solved(model):
        # rows of the other model enter as NULL, which the solver skips
        price = F.when((F.col("_model") == model) & (F.col("iv_status") == "ok"), F.col("close"))
        return implied_vol(
            price, F.col("u_price"), F.col("_k"), F.lit(float(rate)), F.col("rdays") / K.ANNUAL_DAYS, F.col("_cp"),
            model=model,
        )

    models = ("crr",) if routing == "crr" else ("crr", "b76")
    ready = ready.withColumns({f"_iv_{m}": solved(m) for m in models})
    iv = (
        F.when(F.col("iv_status") == "ok", F.coalesce(*[F.col(f"_iv_{m}") for m in models]))
        .when(F.col("iv_status").isin("total", "below_intrinsic", "no_price"), F.lit(0.0))
    )
    return ready.select(
        *keep,
        iv.alias("iv"),
        F.when(total, F.lit(0)).otherwise(F.col("rdays")).alias("rdays"),
        "iv_status",
    )


def unsolved(quotes: DataFrame) -> DataFrame:
    """Quotes of ``quote_iv`` that could not be parsed, dated, priced or solved, with the reason."""
    return quotes.where(~F.col("iv_status").isin("ok", "total")).withColumn("reject_reason", F.col("iv_status"))
