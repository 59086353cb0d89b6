"""Feature vectors as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RISK, DIMENSIONS, MCC_RISK, Norms

MISSING = -1.0


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``value`` held within the bounds; null stays null and NaN stays NaN."""
    return F.when(value < low, F.lit(low)).when((value > high) & ~F.isnan(value), F.lit(high)).otherwise(value)


def rounded(value: Column, places: int = 4) -> Column:
    """Half up in binary floating point, the same in every engine. For values that are not negative."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def rounded_feature(value: Column) -> Column:
    """Four places; the mark of a missing value stays as it is."""
    return F.when(value < 0, value).otherwise(rounded(value, 4))


def minutes_between(earlier: Column, later: Column) -> Column:
    """Minutes with fractions."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 6e7


def hour_of_day(at: Column) -> Column:
    return F.hour(at) / F.lit(23.0)


def day_of_week(at: Column) -> Column:
    """Monday 0 to Sunday 1."""
    return F.weekday(at) / F.lit(6.0)


def flag(value: Column) -> Column:
    return value.cast("double")


def unknown_merchant(known: Column, merchant: Column) -> Column:
    """1 unless ``merchant`` is among ``known``; no list means none is known."""
    return F.when(F.array_contains(F.coalesce(known, F.array().cast("array<string>")), merchant), 0.0).otherwise(1.0)


def mcc_risk(code: Column, risks: dict[str, float] | None = None) -> Column:
    """Risk of a category code, from a map literal of the few codes there are."""
    pairs = F.create_map(*(F.lit(x) for x in chain(*(risks if risks is not None else MCC_RISK).items())))
    return F.coalesce(F.try_element_at(pairs, code), F.lit(DEFAULT_RISK))


def features(norms: Norms | None = None, rounding: str = "all", risks: dict[str, float] | None = None) -> list[Column]:
    """The fourteen features of a payload, in order, named d0 to d13.

    ``rounding``: "all" rounds each to four places, as labels are made; "service" only hour and day.
    """
    if rounding not in ("all", "service"):
        raise ValueError(f"unknown rounding: {rounding}")
    n = norms or Norms()
    c = F.col
    amount, avg, last = c("transaction.amount"), c("customer.avg_amount"), c("last_transaction")
    raw = [
        clamp(amount / n.max_amount),
        clamp(c("transaction.installments") / n.max_installments),
        clamp(F.when(avg == 0, 1.0).otherwise(amount / F.when(avg == 0, 1.0).otherwise(avg) / n.amount_vs_avg_ratio)),
        hour_of_day(c("transaction.requested_at")),
        day_of_week(c("transaction.requested_at")),
        F.when(last.isNull(), MISSING).otherwise(clamp(minutes_between(c("last_transaction.timestamp"), c("transaction.requested_at")) / n.max_minutes)),
        F.when(last.isNull(), MISSING).otherwise(clamp(c("last_transaction.km_from_current") / n.max_km)),
        clamp(c("terminal.km_from_home") / n.max_km),
        clamp(c("customer.tx_count_24h") / n.max_tx_count_24h),
        flag(c("terminal.is_online")),
        flag(c("terminal.card_present")),
        unknown_merchant(c("customer.known_merchants"), c("merchant.id")),
        mcc_risk(c("merchant.mcc"), risks),
        clamp(c("merchant.avg_amount") / n.max_merchant_avg_amount),
    ]
    exact = {3, 4} if rounding == "service" else set(range(DIMENSIONS))
    return [(rounded_feature(x) if i in exact else x).cast("double").alias(f"d{i}") for i, x in enumerate(raw)]


def vectorize(payloads: DataFrame, norms: Norms | None = None, rounding: str = "all", risks: dict[str, float] | None = None) -> DataFrame:
    """``query_id`` and ``vector`` of each payload."""
    return payloads.select(F.col("id").alias("query_id"), F.array(*features(norms, rounding, risks)).alias("vector"))


def installment_value() -> Column:
    return F.col("transaction.amount") / F.col("transaction.installments")


def new_transaction_id() -> Column:
    return F.concat(F.lit("tx-"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
