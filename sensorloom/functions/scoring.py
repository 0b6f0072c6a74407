"""Column expressions for severities, flags, health colours, forecasts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.schema import HORIZON_DAYS, TREND_CUT

# Severity multiples of the threshold, and the cuts for unit-free scores.
HIGH_MULTIPLE, MEDIUM_MULTIPLE = 1.5, 1.2
HIGH_CUT, MEDIUM_CUT = 1.5, 0.75
# Verdict and reason by the most severe word found in the digest.
VERDICT_RULES = [
    ("HIGH", "URGENT_SERVICE",
     "HIGH-severity anomalies were detected, indicating a likely imminent fault."),
    ("MEDIUM", "SCHEDULE_SERVICE",
     "MEDIUM-severity anomalies suggest degradation; schedule service soon."),
    ("MONITOR", "MONITOR",
     "Low-severity deviations detected; keep monitoring the affected parameters."),
]
SAFE_VERDICT = ("SAFE", "No meaningful anomalies were detected in the current data.")
RULE_PREFIX = "[stub] "
FALLBACK_PREFIX = "[fallback] "
HEALTH_RANK = {"red": 0, "yellow": 1, "green": 2}
STATUS_RANK = {"exceeded": 0, "approaching": 1, "stable": 2}


def _steps(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("MONITOR")


def severity(score: Column, threshold: float) -> Column:
    return _steps(score, threshold * HIGH_MULTIPLE, threshold * MEDIUM_MULTIPLE)


def severity_fixed(score: Column, hi: float = HIGH_CUT, mid: float = MEDIUM_CUT) -> Column:
    return _steps(score, hi, mid)


def flag(score: Column, threshold: float) -> Column:
    """True for a real score at or above the threshold; Spark alone would rank NaN above it."""
    return score.isNotNull() & ~F.isnan(score) & (score >= threshold)


def is_trending(slope: Column, cut: float = TREND_CUT) -> Column:
    return F.abs(slope) >= cut


def health(high: Column, medium: Column, monitor: Column) -> Column:
    return F.when(high > 0, "red").when((medium > 0) | (monitor > 0), "yellow").otherwise("green")


def rank_of(col: Column, ranks: dict[str, int]) -> Column:
    """Sort position of an enumerated text column."""
    out = F.lit(None).cast("int")
    for value, rank in ranks.items():
        out = F.when(col == value, rank).otherwise(out)
    return out


def forecast_status(current: Column, limit: Column, slope_per_day: Column,
                    horizon: float = HORIZON_DAYS) -> Column:
    """struct<status, eta_days>; a rising series far from its limit is stable but keeps its ETA."""
    over = current >= limit
    eta = F.when(~over & (slope_per_day > 0), F.try_divide(limit - current, slope_per_day))
    status = F.when(over, "exceeded").when(eta <= horizon, "approaching").otherwise("stable")
    return F.struct(status.alias("status"), eta.alias("eta_days"))


def _verdict(verdict: str, reason: str, prefix: str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(prefix + reason).alias("explanation"))


def verdict_rule(text: Column, prefix: str = RULE_PREFIX) -> Column:
    """struct<verdict, explanation> by the most severe word anywhere in the digest text."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = _verdict(*SAFE_VERDICT, prefix)
    for word, verdict, reason in reversed(VERDICT_RULES):
        out = F.when(upper.contains(word), _verdict(verdict, reason, prefix)).otherwise(out)
    return out


def verdict_by_counts(high: Column, medium: Column, monitor: Column, prefix: str = RULE_PREFIX) -> Column:
    """The same rule on severity counts, immune to machines whose name holds a severity word."""
    out = _verdict(*SAFE_VERDICT, prefix)
    for count, (_, verdict, reason) in zip((monitor, medium, high), reversed(VERDICT_RULES)):
        out = F.when(count > 0, _verdict(verdict, reason, prefix)).otherwise(out)
    return out
