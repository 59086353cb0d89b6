"""Constants of the scoring rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Norms:
    """Ceilings by which amounts, counts and distances are scaled to 0..1."""

    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0


# Risk by merchant category code, and for codes not listed.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.5

DIMENSIONS = 14
NEIGHBOURS = 5
THRESHOLD = 0.6


def read_norms(path: str) -> Norms:
    """Norms from a small JSON object; all its seven numbers must be there."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return Norms(**{n.name: float(found[n.name]) for n in fields(Norms)})


def read_mcc_risk(path: str) -> dict[str, float]:
    """Risk by code from a small JSON object."""
    with open(path, encoding="utf-8") as f:
        return {str(k): float(v) for k, v in json.load(f).items()}
