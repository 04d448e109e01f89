"""Parameter objects. Their defaults are fixed values: they are part of the operators' meaning."""

from __future__ import annotations

from dataclasses import dataclass

TRADING_DAYS = 252


@dataclass(frozen=True)
class Ledger:
    cost_bps: float = 2.0
    cash_rate: float = 0.0
    fixed_low: float = 0.6
    target_volatility: float = 0.10
    volatility_window: int = 20
    ewm_alpha: float = 0.06
    ewm_minimum: int = 20
    trend_window: int = 200
    cap: float = 1.0


@dataclass(frozen=True)
class EventRules:
    confirm: int = 3
    release: int = 5
    cooldown_days: int = 5


@dataclass(frozen=True)
class LabelRules:
    below_average: float = 0.0
    volatility_percentile: float = 0.90
    stress_percentile: float = 0.90
    grade: str = "UNTESTED"


@dataclass(frozen=True)
class ScreenLimits:
    max_age_seconds: float = 60.0
    max_relative_spread: float = 0.15
    min_open_interest: float = 100.0
    max_cost_share: float = 0.05


#: (name, fewest days, most days); day 60 is in both.
EXPIRY_BUCKETS = (("25-60", 25, 60), ("60-95", 60, 95))
MONEYNESS = (-0.02, -0.05, -0.10)
STRIKE_DRIFT = 0.01
PARITY_SLOPE = (-1.05, -0.90)
MOVES = (-0.20, -0.10, -0.05, 0.0, 0.05, 0.10)
TOLERANCE_FLOOR, TOLERANCE_WINDOW, TOLERANCE_MULTIPLE = 5e-5, 250, 6.0
EVENT_HORIZON, EVENT_DEPTH, EPISODE_GAP = 20, 0.05, 5
DIMENSIONS = ("trend", "volatility", "participation", "credit", "implied")
PURPOSES = ("quotes", "day_end", "intraday", "training")
SECURITY_TYPES_WITH_POSITIVE_PRICES = ("STK", "ETF", "FUT")
MARKET_DATA_TYPES = {1: "live", 2: "frozen", 3: "delayed", 4: "delayed_frozen"}
