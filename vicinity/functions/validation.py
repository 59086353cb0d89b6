"""Which payloads and references break which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIMENSIONS


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def below(value: Column, least: float) -> Column:
    """Null or NaN counts as below."""
    return value.isNull() | F.isnan(value.cast("double")) | (value < least)


def errors(rules: list[tuple[str, Column]]) -> Column:
    """Messages of the rules that are broken, in order; an empty array if none."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(message)) for message, broken in rules)))


def payload_rules() -> list[tuple[str, Column]]:
    c = F.col
    last = c("last_transaction")
    return [
        ("id is blank", blank(c("id"))),
        ("amount is not positive", below(c("transaction.amount"), 0) | (c("transaction.amount") == 0)),
        ("installments below 1", below(c("transaction.installments"), 1)),
        ("requested_at is missing", c("transaction.requested_at").isNull()),
        ("customer average is negative", below(c("customer.avg_amount"), 0)),
        ("transaction count is negative", below(c("customer.tx_count_24h"), 0)),
        ("merchant id is blank", blank(c("merchant.id"))),
        ("mcc is blank", blank(c("merchant.mcc"))),
        ("merchant average is negative", below(c("merchant.avg_amount"), 0)),
        ("distance from home is negative", below(c("terminal.km_from_home"), 0)),
        ("is_online is missing", c("terminal.is_online").isNull()),
        ("card_present is missing", c("terminal.card_present").isNull()),
        ("last transaction's time is missing", last.isNotNull() & c("last_transaction.timestamp").isNull()),
        ("last transaction's distance is negative", last.isNotNull() & below(c("last_transaction.km_from_current"), 0)),
    ]


def checked_payloads(payloads: DataFrame) -> DataFrame:
    """``payloads`` with ``errors``; a record that could not be read has that one only."""
    found = errors(payload_rules())
    if "unreadable" in payloads.columns:
        found = F.when(F.col("unreadable").isNotNull(), F.array(F.lit("record is not readable"))).otherwise(found)
    return payloads.withColumn("errors", found)


def split_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid payloads, and rejected ones with their errors."""
    rows = checked_payloads(payloads)
    return rows.where(F.size("errors") == 0).drop("errors", "unreadable"), rows.where(F.size("errors") > 0)


def reference_rules(dims: int = DIMENSIONS) -> list[tuple[str, Column]]:
    v = F.col("vector")
    return [
        ("vector is missing", v.isNull()),
        ("wrong number of dimensions", v.isNotNull() & (F.size(v) != dims)),
        ("vector has a null or NaN", F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))),
        ("label is missing", F.col("label").isNull()),
    ]


def is_fraud(label: Column) -> Column:
    """Labels are compared without regard to case; anything else is no fraud."""
    return F.coalesce(F.lower(label) == "fraud", F.lit(False))
