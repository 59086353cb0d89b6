"""Seeded payloads and references. Every value depends on the seed, its field and the row only, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import rounded, vectorize

# Merchant categories by profile.
LEGIT_MCC = ["5411", "5812", "5912", "5311"]
FRAUD_MCC = ["7995", "7801", "7802"]
ANY_MCC = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999"]


def _draws(seed: int):
    """Uniform numbers below 1, and whole numbers below an upper end, by field.

    They are the first 52 bits of MD5 sums, which other engines have too.
    """

    def uniform(field: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{field}:"), F.col("n").cast("string"))), 1, 13), 16, 10).cast("bigint") / float(1 << 52)

    def whole(field: str, low: int, high: int) -> Column:
        return F.floor(uniform(field) * (high - low)).cast("int") + low

    return uniform, whole


def generate_payloads(spark: SparkSession, n: int, seed: int = 42, fraud_ratio: float = 0.30) -> DataFrame:
    """Payloads with their ``profile`` (LEGIT, FRAUD, BORDERLINE) and ``coin``, a fair flag for borderline labels."""
    uniform, whole = _draws(seed)
    u, profile = uniform("profile"), F.col("profile")

    def by_profile(legit: Column, fraud: Column, borderline: Column) -> Column:
        return F.when(profile == "LEGIT", legit).when(profile == "FRAUD", fraud).otherwise(borderline)

    def between(field: str, *ranges: tuple[float, float]) -> Column:
        return by_profile(*(F.lit(low) + uniform(field) * (high - low) for low, high in ranges))

    def count(field: str, *ranges: tuple[int, int]) -> Column:
        return by_profile(*(whole(field, low, high + 1) for low, high in ranges))

    def merchant(number: Column) -> Column:
        return F.concat(F.lit("MERC-"), F.lpad(number.cast("string"), 3, "0"))

    def one_of(field: str, codes: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, codes)), whole(field, 0, len(codes)) + 1)

    rows = spark.range(n).withColumnRenamed("id", "n")
    rows = rows.withColumn("profile", F.when(u < 1 - fraud_ratio, "LEGIT").when(u < 1 - fraud_ratio + 0.9 * fraud_ratio, "FRAUD").otherwise("BORDERLINE"))
    amount = rounded(between("amount", (10, 500), (2000, 10000), (400, 3000)), 2)
    known = F.slice(F.array(*(merchant(whole(f"known{i}", 1, 20)) for i in range(5))), 1, whole("n_known", 2, 6))
    rows = rows.withColumns({"amount": amount, "known": known, "installments": count("installments", (1, 3), (6, 12), (3, 7))})
    own = F.element_at("known", F.least(whole("own", 1, 6), F.size("known")))
    other = F.when(uniform("familiar") < 0.5, own).otherwise(merchant(whole("other", 30, 60)))
    at = F.timestamp_seconds(F.lit(1772323200) + F.col("day") * 86400 + F.col("hour") * 3600 + whole("minute", 0, 60) * 60 + whole("second", 0, 60))  # from 2026-03-01
    rows = rows.withColumns({"day": whole("day", 9, 27), "hour": count("hour", (8, 20), (0, 6), (6, 22)), "online": uniform("online") < by_profile(F.lit(0.3), F.lit(0.8), F.lit(0.5))})
    rows = rows.withColumn("at", at)
    back = F.col("at") - F.make_dt_interval(mins=count("back", (30, 719), (1, 9), (5, 119)))
    last = F.when(uniform("no_last") >= 0.2, F.struct(back.alias("timestamp"), between("km_last", (0, 20), (200, 1000), (20, 300)).alias("km_from_current")))
    average = F.when(profile == "LEGIT", F.col("amount") * 2).otherwise(rounded(between("average", (0, 0), (50, 300), (100, 500)), 2))
    return rows.select(
        F.concat(F.lit("tx-"), F.col("n").cast("string")).alias("id"),
        F.struct(F.col("amount"), F.col("installments"), F.col("at").alias("requested_at")).alias("transaction"),
        F.struct(average.alias("avg_amount"), count("tx", (1, 5), (8, 20), (4, 11)).alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(
            by_profile(own, merchant(whole("far", 50, 100)), other).alias("id"), by_profile(one_of("mcc", LEGIT_MCC), one_of("mcc", FRAUD_MCC), one_of("mcc", ANY_MCC)).alias("mcc"), rounded(between("shop", (30, 500), (20, 100), (50, 300)), 2).alias("avg_amount")
        ).alias("merchant"),
        F.struct(F.col("online").alias("is_online"), (~F.col("online") & (uniform("card") < 0.9)).alias("card_present"), between("home", (0, 50), (200, 1000), (30, 400)).alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
        "profile",
        (uniform("coin") < 0.5).alias("coin"),
    )


def generate_references(spark: SparkSession, n: int, seed: int = 42, fraud_ratio: float = 0.30) -> DataFrame:
    """``ref_id``, ``vector``, ``is_fraud``: fraud by profile, borderline ones by a fair coin."""
    rows = generate_payloads(spark, n, seed, fraud_ratio)
    vectors = vectorize(rows.withColumn("id", F.struct("id", "profile", "coin")))
    fraud = (F.col("query_id.profile") == "FRAUD") | ((F.col("query_id.profile") == "BORDERLINE") & F.col("query_id.coin"))
    return vectors.select(F.substring("query_id.id", 4, 20).cast("long").alias("ref_id"), "vector", fraud.alias("is_fraud"))


def near_references(refs: DataFrame, n: int, noise: float = 0.005, seed: int = 12648430, dims: int = 14) -> DataFrame:
    """Queries beside known references: about ``n`` of them, each dimension moved by up to ``noise``."""
    chosen = refs.orderBy(F.xxhash64(F.lit(seed), F.col("ref_id"))).limit(n)
    move = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("ref_id")), F.lit(1 << 30)) / float(1 << 29) - 1) * noise
    return chosen.select(F.col("ref_id").alias("query_id"), F.array(*(F.col("vector")[i] + move(i) for i in range(dims))).alias("vector"))


def labelled_set(payloads: DataFrame, decisions: DataFrame) -> DataFrame:
    """``request``, ``expected_approved``, ``expected_fraud_score`` for the payloads that were decided."""
    names = [c for c in payloads.columns if c not in ("profile", "coin")]
    joined = payloads.select(F.struct(*names).alias("request"), F.col("id")).join(decisions, "id")
    return joined.select("request", F.col("approved").alias("expected_approved"), F.col("fraud_score").alias("expected_fraud_score"))
