"""Frozen rule constants.

Every value in this file is a fixed value: results only match when they are
exactly these numbers and words.
"""

from __future__ import annotations

from dataclasses import dataclass

# Signal rule.
SCORE_THRESHOLD = 90
STOP_LOSS_PCT = -0.10
TAKE_PROFIT_PCT = 0.30
MAX_HOLDING_SESSIONS = 60
WEEKLY_MA_WINDOW = 200
RSI_WINDOW = 14
VOLUME_MA_WINDOW = 30
VOLUME_MULTIPLE = 1.5
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
RSI_LOW, RSI_HIGH = 40, 65

# Flag -> (score weight, mask bit), in mask order.
FLAGS = {
    "weekly_above_200ma": (30, 1),
    "weekly_macd_gc": (30, 2),
    "weekly_macd_uptrend": (20, 4),
    "daily_rsi_40_65": (20, 8),
    "daily_volume_1_5x": (20, 16),
}
SCORE_BUCKETS = (90, 100, 110, 120)
SCORE_MASKS = (15, 23, 29, 30, 31)

# Portfolio and paper ledger.
PORTFOLIO_SLOTS = 10
INITIAL_CAPITAL = 10_000_000.0
PAPER_CAPITAL = 3_000_000.0
PAPER_SIZE = 500_000.0
PAPER_SLOTS = 6
DATA_END_HAIRCUT = 0.8
DAYS_PER_YEAR = 365.2425

# Exit groups in report order.
EXIT_GROUPS = (
    "stop_loss",
    "stop_gap",
    "take_profit",
    "take_profit_gap",
    "max_holding",
    "data_end_or_haircut",
    "other",
)
DISPOSITIONS = (
    "accepted",
    "capacity_rejected",
    "duplicate_rejected",
    "missing_next_session",
    "invalid_bar",
)
SPLITS = ("development", "validation", "final_holdout")

# Robust-hypothesis policy.
MIN_CLOSED_TRADES = 30
MIN_MONTH_CLUSTERS = 12
BOOTSTRAP_REPLICATES = 10_000
BOOTSTRAP_SEED = 20260727
BOOTSTRAP_CONFIDENCE = 0.95
MIN_VALID_FRACTION = 0.99
MIN_SAME_DIRECTION = 0.95
MAX_TOP_TICKER_SHARE = 0.25
MAX_TOP_SECTOR_SHARE = 0.50
HIGH_EXPOSURE = 0.80
MAX_ACTIONABLE = 2
HYPOTHESES = (
    # id, value column, expected sign
    ("A_ADDED_SIGNAL_QUALITY", "net_return_pct", -1),
    ("B_CAPACITY_PRIORITY", "net_return_pct", 1),
    ("C_HIGH_EXPOSURE", "net_return_pct", -1),
    ("D_EXIT_ATTRIBUTION", "negative_exit_burden", 1),
    ("E_SCORE_MONOTONICITY", "net_return_pct", -1),
)

# Issue master and calendar codes.
SESSION_DIVISIONS = ("1", "2")
INCLUDED_MARKETS = ("0101", "0102", "0106", "0111", "0112")
EQUITY_PRODUCTS = ("011",)
BLANK_SECTORS = ("", "0", "0000", "9999")
STRONG_SECTORS = (
    "Trading companies",
    "Machinery",
    "Nonferrous metals",
    "Real estate",
    "Shipbuilding",
)


@dataclass(frozen=True)
class Scenario:
    """One cost and path assumption; rates are per side, in basis points."""

    cost: str
    path: str
    commission_bps: float
    slippage_bps: float

    @property
    def name(self) -> str:
        return f"{self.cost}:{self.path}"

    @property
    def commission(self) -> float:
        return self.commission_bps / 10_000.0

    @property
    def slippage(self) -> float:
        return self.slippage_bps / 10_000.0


# Cost ladder and path policies.
SCENARIOS = (
    Scenario("zero", "conservative", 0.0, 0.0),
    Scenario("basic", "conservative", 10.0, 10.0),
    Scenario("strict", "conservative", 20.0, 30.0),
    Scenario("basic", "optimistic", 10.0, 10.0),
)
PRIMARY = SCENARIOS[1]


@dataclass(frozen=True)
class UniverseRule:
    """Liquidity-ranked universe: size, sector cap and eligibility thresholds."""

    name: str
    target: int
    sector_cap: int
    min_liquidity: float
    min_close: float = 300.0
    min_completeness: float = 0.98
    min_months_listed: int = 60


# The two ranked universes.
UNIVERSE_RULES = (
    UniverseRule("liquid50", 50, 8, 1.0e9),
    UniverseRule("liquid100", 100, 15, 3.0e8),
)
