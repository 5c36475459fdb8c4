"""Closed-form scores: decay, coherence, confidence, fusion terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS, DECAY_FLOOR = 90.0, 0.1
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT, MISSING = 20, 0.6, 0.4, 0.1


def round_half_up(x: Column, places: int = 4) -> Column:
    """Rounding of non-negative numbers, halves away from zero, the same in any engine."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def age_days(ts: Column, as_of: Column) -> Column:
    """Days from ``ts`` to ``as_of``, with fractions."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400e6


def recency_decay(days: Column, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR, enabled: bool = True) -> Column:
    """Half-life decay, never under ``floor``; 1 when switched off."""
    return F.greatest(F.lit(floor), F.pow(F.lit(2.0), -days / half_life)) if enabled else F.lit(1.0)


def frequency(count: Column, threshold: int = 5) -> Column:
    """Accesses as a share of ``threshold``, at most 1."""
    return F.least(count.cast("double") / threshold, F.lit(1.0))


def coherence(days: Column, count: Column, semantic: Column, alpha=0.3, beta=0.2, gamma=0.5, half_life=HALF_LIFE_DAYS, floor=DECAY_FLOOR) -> Column:
    """Weighted recency, frequency and semantic fit."""
    return alpha * recency_decay(days, half_life, floor) + beta * frequency(count) + gamma * semantic


def confidence_after(confidence: Column, success: Column, up: float = 0.05, down: float = 0.15) -> Column:
    """Confidence after one outcome, kept from 0 to 1; unknown starts at one half."""
    change = F.when(success, F.lit(up)).otherwise(F.lit(-down))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5)) + change))


def confidence_decayed(confidence: Column, days: Column, half_life: float = 30.0, floor: float = 0.1) -> Column:
    """One decay step for confidences above zero that are older than a day; calls compound."""
    lower = F.greatest(F.lit(0.0), confidence * F.greatest(F.lit(floor), F.pow(F.lit(2.0), -days / half_life)))
    return F.when((confidence > 0) & (days > 1), lower).otherwise(confidence)


def rrf_term(rank: Column, weight: float, k: int = RRF_K) -> Column:
    """A list's part in reciprocal rank fusion (Cormack, Clarke and Buettcher, 2009); ranks from 1, 0 for the absent."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def relative(score: Column, most: Column, weight: float, missing: float = MISSING) -> Column:
    """A list's part in relative score fusion: the share of the largest score, or ``missing`` for the absent."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / F.greatest(most, F.lit(1e-12))))
    return weight * F.when(score.isNull(), F.lit(missing)).otherwise(share)


def running_success(successes: Column, runs: Column) -> Column:
    """Success rate from totals; 0 without runs."""
    return F.when(runs > 0, successes.cast("double") / runs).otherwise(F.lit(0.0))
