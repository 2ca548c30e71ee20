"""Fixed values of the benchmark definition."""

from __future__ import annotations

from statistics import NormalDist

# Event types that are kept when raw events are flattened.
KEEP_EVENT_TYPES = (
    "WatchEvent",
    "PullRequestEvent",
    "IssuesEvent",
    "PushEvent",
)

# The count metrics of one entity.
METRICS = ("stars", "prs_opened", "issues_opened", "pushes")

# Quantile levels in percent.
LEVELS = (10, 20, 30, 40, 50, 60, 70, 80, 90)

# Minimum share of hours a period needs, by frequency.
COMPLETENESS = {"daily": 0.90, "weekly": 0.95, "monthly": 0.99}
DEFAULT_COMPLETENESS = 0.90

# Lower clips of the error scales.
MASE_EPS = 1e-2
CRPS_EPS = 1.0

# Quantile gaps are filled only below this share of rows.
QUANTILE_FILL_LIMIT = 0.05

# Leaderboard scaling.
ZERO_MODEL = "zero_model"
DENOM_FLOOR = 1e-3
LEADERBOARD_FREQUENCIES = ("daily", "weekly", "monthly")
DATASET = "gh-archive"

# Hours whose archive files are known to be absent or broken.
KNOWN_BAD_HOURS = ("2025-06-12-17", "2025-06-12-18", "2023-05-14-19")

# First hour of the archive and default sample salt.
ARCHIVE_START = "2023-01-01-00"
SAMPLE_SALT = "v0.1.0"


def z_score(level: int) -> float:
    """Standard normal quantile of a level in percent."""
    return round(NormalDist().inv_cdf(level / 100), 10)
