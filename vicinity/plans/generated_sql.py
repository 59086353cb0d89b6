"""SQL for DuckDB that draws the same payloads as ``sources.generate`` and scores them by brute force."""

from __future__ import annotations

from ..config import MCC_RISK, Norms
from ..sources.generate import ANY_MCC, FRAUD_MCC, LEGIT_MCC


def _payloads(n: int, seed: int, fraud_ratio: float) -> str:
    """A SELECT of the fields that features and statistics need."""

    def u(field: str) -> str:
        return f"(CAST('0x' || substr(md5('{seed}:{field}:' || n), 1, 13) AS BIGINT) / 4503599627370496e0)"

    def whole(field: str, low: int, high: int) -> str:
        return f"(CAST(floor({u(field)} * {high - low}) AS INTEGER) + {low})"

    def by(legit: str, fraud: str, borderline: str) -> str:
        return f"CASE profile WHEN 'LEGIT' THEN {legit} WHEN 'FRAUD' THEN {fraud} ELSE {borderline} END"

    def between(field: str, *ranges: tuple[int, int]) -> str:
        return "(" + by(*(f"{low} + {u(field)} * {high - low}" for low, high in ranges)) + ")"

    def count(field: str, *ranges: tuple[int, int]) -> str:
        return by(*(whole(field, low, high + 1) for low, high in ranges))

    def cents(value: str) -> str:
        return f"floor({value} * 100e0 + 0.5e0) / 100e0"

    def merchant(number: str) -> str:
        return f"'MERC-' || lpad(CAST({number} AS VARCHAR), 3, '0')"

    def one_of(field: str, codes: list[str]) -> str:
        return f"[{', '.join(repr(c) for c in codes)}][{whole(field, 0, len(codes))} + 1]"

    known = ", ".join(merchant(whole(f"known{i}", 1, 20)) for i in range(5))
    shares = f"CASE WHEN {u('profile')} < {1 - fraud_ratio!r}::DOUBLE THEN 'LEGIT' WHEN {u('profile')} < {1 - fraud_ratio + 0.9 * fraud_ratio!r}::DOUBLE THEN 'FRAUD' ELSE 'BORDERLINE' END"
    return f"""SELECT *, {by('own', merchant(whole('far', 50, 100)), f"CASE WHEN {u('familiar')} < 0.5e0 THEN own ELSE {merchant(whole('other', 30, 60))} END")} AS merchant,
  {by('amount * 2', *[cents(between('average', (0, 0), (50, 300), (100, 500)))] * 2)} AS average, NOT online AND {u('card')} < 0.9e0 AS card
FROM (SELECT *, known[least({whole('own', 1, 6)}, len(known))] AS own FROM (SELECT n, profile, {cents(between('amount', (10, 500), (2000, 10000), (400, 3000)))} AS amount, list_slice([{known}], 1, {whole('n_known', 2, 6)}) AS known,
  {count('installments', (1, 3), (6, 12), (3, 7))} AS installments, {whole('day', 9, 27)} AS day, {count('hour', (8, 20), (0, 6), (6, 22))} AS hour, {u('online')} < {by('0.3e0', '0.8e0', '0.5e0')} AS online,
  CASE WHEN {u('no_last')} >= 0.2e0 THEN {count('back', (30, 719), (1, 9), (5, 119))} END AS back, {between('km_last', (0, 20), (200, 1000), (20, 300))} AS km_last, {count('tx', (1, 5), (8, 20), (4, 11))} AS tx,
  {by(one_of('mcc', LEGIT_MCC), one_of('mcc', FRAUD_MCC), one_of('mcc', ANY_MCC))} AS mcc, {cents(between('shop', (30, 500), (20, 100), (50, 300)))} AS shop, {between('home', (0, 50), (200, 1000), (30, 400))} AS home, {u('coin')} < 0.5e0 AS coin
FROM (SELECT n, {shares} AS profile FROM range({n}) t(n))))"""


def statistics(n: int, seed: int, fraud_ratio: float) -> str:
    return f"SELECT profile, count(*) AS n, min(amount) AS least, max(amount) AS most, count(*) FILTER (WHERE back IS NULL) AS first_ones FROM ({_payloads(n, seed, fraud_ratio)}) GROUP BY profile"


def _features(n: int, seed: int, fraud_ratio: float) -> str:
    m = Norms()
    risk = " ".join(f"WHEN '{code}' THEN {value!r}::DOUBLE" for code, value in MCC_RISK.items())
    flag = lambda condition: f"CASE WHEN {condition} THEN 1e0 ELSE 0e0 END"
    raw = [
        f"amount / {m.max_amount}::DOUBLE", f"installments / {m.max_installments}::DOUBLE", f"CASE WHEN average = 0 THEN 1e0 ELSE amount / average / {m.amount_vs_avg_ratio}::DOUBLE END", "hour / 23e0",
        "((day + 6) % 7) / 6e0",  # the first day, before which ``day`` counts from 0, is a Sunday
        f"back / {m.max_minutes}::DOUBLE", f"CASE WHEN back IS NOT NULL THEN km_last / {m.max_km}::DOUBLE END", f"home / {m.max_km}::DOUBLE", f"tx / {m.max_tx_count_24h}::DOUBLE", flag("online"), flag("card"),
        flag("NOT list_contains(known, merchant)"), f"CASE mcc {risk} ELSE 0.5e0 END", f"shop / {m.max_merchant_avg_amount}::DOUBLE",
    ]
    four = lambda i: f"coalesce(floor((CASE WHEN r{i} < 0 THEN 0e0 WHEN r{i} > 1 THEN 1e0 ELSE r{i} END) * 1e4 + 0.5e0) / 1e4, -1e0) AS d{i}"
    named = ", ".join(f"{x} AS r{i}" for i, x in enumerate(raw))
    return f"SELECT n, profile = 'FRAUD' OR (profile = 'BORDERLINE' AND coin) AS is_fraud, {', '.join(map(four, range(14)))} FROM (SELECT *, {named} FROM ({_payloads(n, seed, fraud_ratio)}))"


def decisions(queries: tuple[int, int, float], references: tuple[int, int, float], k: int = 5) -> str:
    """``id``, ``fraud_score``, ``approved`` of generated payloads by their ``k`` nearest generated references."""
    d2 = " + ".join(f"(q.d{i} - r.d{i}) * (q.d{i} - r.d{i})" for i in range(14))
    return f"""WITH q AS ({_features(*queries)}), r AS ({_features(*references)}), near AS (
  SELECT q.n, r.is_fraud, row_number() OVER (PARTITION BY q.n ORDER BY {d2}, r.n) AS rank FROM q, r QUALIFY rank <= {k}
), votes AS (SELECT n, count(*) AS total, CAST(sum(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS frauds FROM near GROUP BY n)
SELECT 'tx-' || n AS id, CAST(frauds AS DOUBLE) / total AS fraud_score, 5 * frauds < 3 * total AS approved FROM votes"""
