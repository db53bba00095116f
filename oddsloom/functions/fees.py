"""Fees, rebates, slippage and order sizes as columns, in exact decimals where money is rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsloom.functions.floats import ratio

# Fixed values.
CRYPTO_LABELS = ("crypto",)
FEE_LABELS = (
    "culture", "economics", "finance", "general", "mentions", "other", "other general", "politics", "sports", "tech",
    "weather",
)
CRYPTO_BPS = (70, 700)
FEE_BPS = (30, 40, 50, 300, 400, 500)
CRYPTO_REBATE, FEE_REBATE = "0.20", "0.25"
AFFORDABILITY_BUFFER = "0.97"
EXCHANGE_FEE_RATE = "0.07"


def _dec(c: Column, scale: int = 8) -> Column:
    return c.cast(f"decimal({10 + scale},{scale})")


def quadratic_fee(quantity: Column, price: Column, rate: Column, is_taker: Column) -> Column:
    """quantity * rate * p * (1 - p), half up to five places; makers and zero rates pay nothing."""
    p = _dec(price, 6)
    fee = (_dec(quantity, 6) * _dec(rate, 6)).cast("decimal(24,8)") * (p * (F.lit(1).cast("decimal(1,0)") - p)).cast(
        "decimal(14,12)"
    )
    charged = is_taker & (rate > 0)
    return F.when(charged, F.round(fee, 5).cast("double")).otherwise(0.0)


def ceiling_fee(
    quantity: Column, price: Column, rate: Column, *, order_ts: Column | None = None, waived_until: Column | None = None
) -> Column:
    """quantity * rate * p * (1 - p) rounded up to the cent; nothing outside (0, 1) or under a waiver."""
    p = _dec(price, 6)
    raw = (_dec(quantity, 6) * _dec(rate, 6)).cast("decimal(24,8)") * (p * (F.lit(1).cast("decimal(1,0)") - p)).cast(
        "decimal(14,12)"
    )
    charged = (rate > 0) & (price > 0) & (price < 1)
    if waived_until is not None:
        charged = charged & ~F.coalesce(order_ts <= waived_until, F.lit(False))
    return F.when(charged, F.ceil(raw, F.lit(2)).cast("double")).otherwise(0.0)


def normal_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "[_\\-\\s]+", " "))


def maker_rebate_rate(labels: Column, bps: Column) -> Column:
    """Rebate share by category labels first, then by the fee in basis points; 0 if neither tells."""
    clean = F.transform(labels, normal_label)
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    has = lambda ws: F.coalesce(F.arrays_overlap(clean, words(ws)), F.lit(False))
    exact = lambda x: F.lit(x).cast("decimal(4,2)")
    return (
        F.when(bps <= 0, exact("0"))
        .when(has(CRYPTO_LABELS), exact(CRYPTO_REBATE))
        .when(has(FEE_LABELS), exact(FEE_REBATE))
        .when(bps.isin(*CRYPTO_BPS), exact(CRYPTO_REBATE))
        .when(bps.isin(*FEE_BPS), exact(FEE_REBATE))
        .otherwise(exact("0"))
    )


def maker_rebate(quantity: Column, price: Column, bps: Column, share: Column) -> Column:
    """The rebate share of the fee a taker would have paid, half up to five places."""
    fee = quadratic_fee(quantity, price, bps / 10_000, F.lit(True))
    rebate = fee.cast("decimal(18,5)") * share.cast("decimal(4,2)")
    return F.when((bps > 0) & (share > 0), F.round(rebate, 5).cast("double")).otherwise(0.0)


def slipped_price(action: Column, bid: Column, ask: Column, tick: Column, ticks: Column, pct: Column) -> Column:
    """Buys at the ask plus ticks and percent, sells at the bid minus both, within [0, 1]."""
    buy = F.least(F.lit(1.0), ask + tick * ticks + ask * pct)
    sell = F.greatest(F.lit(0.0), bid - tick * ticks - bid * pct)
    return F.when(action == "buy", buy).otherwise(sell)


def affordable_size(desired: Column, price: Column, taker_fee: Column, balance: Column, visible: Column, *, clamp: bool = True) -> Column:
    """Desired size within the balance (with its buffer) and the visible size.

    Without a reference price the worst case of 1 is assumed; NULL balance or visible size do not cap.
    Without `clamp` prices count as they are: above 1 they cost more, and at 0 cash does not cap.
    """
    ref = F.when(price > 0, price).otherwise(1.0)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ref)) if clamp else price
    fee = F.greatest(F.lit(0.0), taker_fee)
    unit = p + fee * p * (1 - p)
    limit = ratio(balance * float(AFFORDABILITY_BUFFER), unit)
    by_cash = F.when(balance.isNull(), desired).otherwise(F.greatest(F.lit(0.0), F.least(desired, limit)))
    capped = F.when(visible.isNull(), by_cash).when(visible <= 0, 0.0).otherwise(F.least(by_cash, visible))
    return F.when(desired <= 0, 0.0).otherwise(capped)
