"""Scores, decays and classes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae import schema as S

ALPHA = 0.6


def age_days(at: Column, now: Column) -> Column:
    """Days from a timestamp to another, never negative."""
    return F.greatest(F.lit(0.0), days_between(at, now))


def days_between(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def bm25_share(score: Column) -> Column:
    """A BM25 score of 0 or more as a number from 0 to 1, whatever the other scores are."""
    s = F.greatest(F.lit(0.0), score)
    return s / (1 + s)


def recency(at: Column, now: Column, days: float) -> Column:
    return F.exp(-age_days(at, now) / days)


def broad(strength: Column, at: Column, now: Column) -> Column:
    return 0.8 * strength + 0.2 * recency(at, now, 30.0)


def hybrid(cosine: Column, lexical: Column, alpha: float) -> Column:
    return alpha * cosine + (1 - alpha) * lexical


def kept(consolidated: Column) -> Column:
    """The share of its strength that a memory keeps in a cycle."""
    return F.when(consolidated, S.CONSOLIDATED_DECAY).otherwise(S.WORKING_DECAY)


def missed_cycles(since: Column, now: Column) -> Column:
    """Whole days gone but one, MOST_CYCLES at most."""
    return F.least(F.lit(S.MOST_CYCLES), F.greatest(F.lit(0), F.floor(days_between(since, now)).cast("int") - 1))


def merge_score(jaccard: Column, cosine: Column) -> tuple[Column, Column]:
    """(score, threshold); a null cosine leaves the Jaccard score alone."""
    with_vectors = cosine.isNotNull()
    score = F.when(with_vectors, S.MERGE_JACCARD * jaccard + S.MERGE_COSINE * F.greatest(F.lit(0.0), cosine)).otherwise(jaccard)
    return score, F.when(with_vectors, S.MERGE_COMBINED).otherwise(S.MERGE_JACCARD_ALONE)


def import_strength(date: Column, now: Column) -> Column:
    """1 without a date and for the future, else the consolidated decay of each day since, 0.05 at least."""
    days = days_between(date.cast("timestamp"), now)
    return F.when(date.isNull() | (days <= 0), 1.0).otherwise(F.greatest(F.pow(F.lit(S.CONSOLIDATED_DECAY), days), F.lit(0.05)))


def valid_rating(rating: Column) -> Column:
    return F.coalesce((rating == F.floor(rating)) & rating.between(1, 5), F.lit(False))


def feedback_evidence(rating: Column) -> Column:
    return F.when(rating >= 4, "agent_feedback_positive").when(rating == 3, "agent_feedback_neutral").otherwise("agent_feedback_negative")


def confidence_of(evidence: Column) -> Column:
    """The confidence that each kind of evidence is worth."""
    worth = {"auto_injected": 0.15, "tool_search_returned": 0.3, "tool_get": 0.6, "agent_feedback_positive": 0.95, "agent_feedback_neutral": 0.4, "agent_feedback_negative": -0.5}
    out = F.lit(None).cast("double")
    for kind, value in worth.items():
        out = F.when(evidence == kind, value).otherwise(out)
    return out


def budget_class(budget: Column, used: Column) -> Column:
    """How much of a token budget is left: high over 75 %, medium over 25 %, low over 5 %, else none; no budget is high."""
    left = F.greatest(F.lit(0.0), budget - used) / budget
    return F.when(budget.isNull() | (budget <= 0), "high").when(left > 0.75, "high").when(left > 0.25, "medium").when(left > 0.05, "low").otherwise("none")


RECALL_LIMITS = {False: {"high": 8, "medium": 5, "low": 2, "none": 0}, True: {"high": 5, "medium": 3, "low": 1, "none": 0}}


def recall_limit(kind: Column, other_recall: bool = False) -> Column:
    """How many memories to recall for a budget class; fewer where another source of recall is active."""
    out = F.lit(0)
    for name, n in RECALL_LIMITS[other_recall].items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def either(weights: Column) -> Column:
    """Aggregate: the chance that one of several independent weights holds; exact where a weight is 1."""
    return 1 - F.product(1 - weights)
