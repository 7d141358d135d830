"""Edge weights: from evidence, by reinforcement, decay and co-access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import BASE_WEIGHTS, CONFIG


def clamp(c: Column, low: float = CONFIG.weight_low, high: float = CONFIG.weight_high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def base_weight(relationship: Column) -> Column:
    out = F.lit(BASE_WEIGHTS["related_to"])
    for name, w in BASE_WEIGHTS.items():
        out = F.when(relationship == name, w).otherwise(out)
    return out


def edge_confidence(support: Column, contradict: Column) -> Column:
    return (support + 1) / (support + contradict + 2)


def recency(seen: Column, as_of: Column) -> Column:
    """From 1 (now, or never seen) down to a half; falls with a period of 30 days."""
    days = F.greatest((as_of.cast("timestamp").cast("double") - seen.cast("timestamp").cast("double")) / 86400, F.lit(0.0))
    return F.when(seen.isNull(), 1.0).otherwise(0.5 + 0.5 * F.exp(-days / 30))


def similarity_or_half(avg_sim: Column) -> Column:
    return F.when(avg_sim > 0, avg_sim).otherwise(0.5)


def computed_weight(relationship: Column, support: Column, contradict: Column, avg_sim: Column, seen: Column, as_of: Column) -> Column:
    """Weight of an edge from its type, its evidence, its similarity and how recently it was seen."""
    raw = base_weight(relationship) * similarity_or_half(avg_sim) * (0.5 + 0.5 * edge_confidence(support, contradict)) * recency(seen, as_of)
    return clamp(raw)


def evidence_score(relationship: Column, support: Column, contradict: Column, avg_sim: Column) -> Column:
    return base_weight(relationship) * edge_confidence(support, contradict) * similarity_or_half(avg_sim)


def reinforced(weight: Column, access: Column, confidence: Column, avg_sim: Column) -> Column:
    return clamp(weight + 0.02 + 0.08 * F.least(F.lit(1.0), access / 20) * confidence * avg_sim)


def decayed(weight: Column, access: Column, last: Column, as_of: Column, rate: float = CONFIG.base_decay, stale_days: int = CONFIG.stale_days, factor: float = CONFIG.stale_factor) -> Column:
    """Slower for edges accessed often, faster for those not reinforced for a week; never under the least weight."""
    age = (as_of.cast("timestamp").cast("double") - last.cast("timestamp").cast("double")) / 86400
    r = rate / F.log(1 + F.greatest(F.lit(1), access))
    return F.greatest(F.lit(CONFIG.weight_low), weight * (1 - r * F.when(age > stale_days, factor).otherwise(1.0)))


def hebbian(weight: Column, times: Column, rate: float = CONFIG.hebbian_rate) -> Column:
    """`times` steps of w + rate * (1 - w) at once."""
    return clamp(1 - (1 - weight) * F.pow(F.lit(1 - rate), times))


def hebbian_new(times: Column, rate: float = CONFIG.hebbian_rate) -> Column:
    """A new edge starts at the rate and takes the remaining steps."""
    return clamp(1 - (1 - rate) * F.pow(F.lit(1 - rate), times - 1))
