"""Settings and fixed tables of the contest model."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Results depend on these being exactly as written.
# ---------------------------------------------------------------------------

DEFAULT_LEAGUE = "NBA"

# Free throws that end a possession.
FREE_THROW_POSSESSION_SHARE = 0.44

MINUTES_BY_PERIOD_TYPE = {"QUARTER": 10, "OVERTIME": 5, "GAME": 40}
PACE_MINUTES = 40

# (label, period number, period type, key of the score object)
PERIOD_LABELS = [
    ("1Q", 1, "QUARTER", "period1"),
    ("2Q", 2, "QUARTER", "period2"),
    ("3Q", 3, "QUARTER", "period3"),
    ("4Q", 4, "QUARTER", "period4"),
    ("1ST", 1, "QUARTER", "period1"),
    ("2ND", 2, "QUARTER", "period2"),
    ("3RD", 3, "QUARTER", "period3"),
    ("4TH", 4, "QUARTER", "period4"),
    ("OT", 1, "OVERTIME", "overtime"),
    ("OT1", 1, "OVERTIME", "overtime"),
    ("OT2", 2, "OVERTIME", "overtime2"),
    ("OT3", 3, "OVERTIME", "overtime3"),
    ("1OT", 1, "OVERTIME", "overtime"),
    ("2OT", 2, "OVERTIME", "overtime2"),
    ("3OT", 3, "OVERTIME", "overtime3"),
]

STATUS_BY_SOURCE = {"finished": "FINISHED", "inprogress": "LIVE", "notstarted": "SCHEDULED"}

SEASON_PATTERNS = {"2526": "%25/26%", "2425": "%24/25%", "2324": "%23/24%"}

# (months, weight, label)
SEASON_TIERS = [
    ((12, 1, 2, 3), 1.0, "golden"),
    ((10, 11), 0.5, "noise"),
    ((4, 5, 6), 0.2, "anomaly"),
]
DEFAULT_SEASON_WEIGHT = 0.5

UNPROFITABLE_LEAGUES = ["CBA"]
STRICT_THRESHOLDS = {"ACB": 0.60}
DEFAULT_MIN_THRESHOLD = 0.54

LEAGUE_GROUPS = {
    "LegaA": ("base", "fatigue", "team_adv"),
    "EuroLeague": ("base", "fatigue", "team_adv"),
    "ACB": ("base", "fatigue", "team_adv"),
    "NBA": ("base", "fatigue"),
    "BBL": ("base", "fatigue"),
    "LNB": ("base", "team_adv"),
    "Israel": ("base",),
    "BLeague": ("base",),
    "NBL": ("base",),
    "ABA": ("base",),
    "CBA": ("base",),
}
DEFAULT_GROUPS = ("base",)

# name -> (included leagues, excluded leagues); no included league means all
PIPELINES = {
    "NBA": (("NBA",), ()),
    "EuroLeague": (("EuroLeague",), ()),
    "OTHER (control)": ((), ("NBA", "EuroLeague")),
}

COMBOS = {
    "BASE": ("base",),
    "BASE+FATIGUE": ("base", "fatigue"),
    "BASE+TEAM_ADV": ("base", "team_adv"),
    "BASE+FATIGUE+TEAM_ADV": ("base", "fatigue", "team_adv"),
}
GRID_THRESHOLDS = (0.54, 0.56, 0.58)

# period -> (target column, a market line exists)
TARGET_PERIODS = {
    "game": ("game_total", True),
    "1q": ("q1_total", False),
    "1h": ("h1_total", False),
}

# ---------------------------------------------------------------------------
# Settings a caller may change.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSettings:
    score_windows: tuple[int, ...] = (3, 5)
    pace_windows: tuple[int, ...] = (3, 5, 10)
    ema_span: int = 5
    rest_default: int = 7
    rest_max: int = 21
    short_days: int = 4
    long_days: int = 7
    density_games: int = 3
    venue_window: int = 5
    season_start: str = "2025-08-01"
    playoff_start: str = "2026-04-19"


@dataclass(frozen=True)
class BetSettings:
    odds: float = 1.90
    stake: float = 1.0
    thresholds: tuple[float, ...] = (0.50, 0.52, 0.54, 0.56, 0.58, 0.60)
    draws: int = 5000
    seed: int = 42
    alpha: float = 0.05
    min_train_rows: int = 100
    min_test_rows: int = 30
    min_bets: int = 10


@dataclass(frozen=True)
class TreeSettings:
    iterations: int = 800
    learning_rate: float = 0.05
    depth: int = 5
    seed: int = 42
    #: the fewest training rows of a leaf; stands in for the leaf penalty that MLlib lacks
    min_leaf_rows: int = 1
    #: the share of rows held out for early stopping
    test_share: float = 0.20
    #: boosting stops after so many rounds without a smaller held-out error
    patience: int = 50


@dataclass(frozen=True)
class ScaleSettings:
    """Limits that decide how an operator is planned, never what it returns."""

    #: an entity with more rows than this is processed in several tasks
    hot_rows: int = 2_000_000
    #: width of the time cells a hot entity is cut into
    cell_seconds: int = 86_400


FEATURES = FeatureSettings()
BETS = BetSettings()
TREES = TreeSettings()
#: the pace model's own size
PACE_TREES = TreeSettings(iterations=1000, depth=6)
#: size of all trees in registered queries, which fit dozens of models on small test tables
QUERY_TREES = TreeSettings(iterations=3, depth=3)
SCALE = ScaleSettings()
