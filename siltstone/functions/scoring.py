"""Scores as Column expressions; ``as_of`` is always given, nothing reads the clock.

Null, missing or unparsable dates take the documented defaults; null counts count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the priority score.
WEIGHTS = {"recency": 0.2975, "linkedness": 0.2550, "access": 0.1700, "confidence": 0.1275, "feedback": 0.1500}
#: What an outcome is worth.
OUTCOMES = {"useful": 1.0, "dead_end": -1.0, "corrected": -2.0}
CONFIDENCE_HALF_LIFE, FEEDBACK_HALF_LIFE, CHANGE_TIME = 90.0, 45.0, 180.0


def days_since(date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, date)


def recency(date: Column, as_of: Column) -> Column:
    """1 / (1 + 0.05 days); 0.1 without a date; future dates count as today."""
    return F.when(date.isNull(), 0.1).otherwise(1 / (1 + 0.05 * F.greatest(days_since(date, as_of), F.lit(0))))


def saturating(n: Column, full: int) -> Column:
    """ln(1 + n) / ln(1 + full), at most 1."""
    return F.least(F.lit(1.0), F.log1p(F.coalesce(n, F.lit(0)).cast("double")) / F.log1p(F.lit(float(full))))


def confidence(base: Column, sources: Column, date: Column, as_of: Column) -> Column:
    """Halves every 90 days, plus up to 0.25 for sources, kept in 0.05..1; no or a future date counts as 30 days."""
    days = days_since(date, as_of)
    days = F.when(days.isNull() | (days < 0), 30).otherwise(days)
    kept = F.coalesce(base, F.lit(0.5)) * F.pow(F.lit(0.5), days / CONFIDENCE_HALF_LIFE)
    bonus = F.least(F.lit(0.25), F.greatest(F.lit(0), F.coalesce(sources, F.lit(0)) - 1) * 0.05)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), kept + bonus))


def priority(recent: Column, linked: Column, accessed: Column, sure: Column, feedback: Column) -> Column:
    w = WEIGHTS
    return w["recency"] * recent + w["linkedness"] * linked + w["access"] * accessed + w["confidence"] * sure + w["feedback"] * F.coalesce(feedback, F.lit(0.5))


def outcome_value(outcome: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in OUTCOMES.items() for x in (F.lit(k), F.lit(v))]), outcome)


def feedback_weight(age_days: Column) -> Column:
    """Halves every 45 days; an event without a time weighs 1."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / FEEDBACK_HALF_LIFE), F.lit(1.0))


def logistic(net: Column) -> Column:
    return 1 / (1 + F.exp(-net / 2))


def change_weight(age_days: Column) -> Column:
    return F.exp(-age_days / CHANGE_TIME)
