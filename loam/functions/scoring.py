"""Numeric functions of ranking and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the score's factors, by profile; the last one is subtracted.
FACTORS = ("similarity", "recency", "confidence", "access", "feedback", "fts", "risk", "graph", "path", "specificity")
PROFILES = {
    "default": (0.4, 0.15, 0.12, 0.05, 0.08, 0.1, 0.05, 0.03, 0.02, 0.08),
    "code_review": (0.3, 0.1, 0.15, 0.05, 0.1, 0.1, 0.1, 0.05, 0.05, 0.08),
    "planning": (0.25, 0.2, 0.1, 0.05, 0.1, 0.1, 0.05, 0.1, 0.05, 0.1),
}
RISK_BOOST = {"low": 0.0, "medium": 0.3, "high": 0.7, "critical": 1.0}


def half_up(x: Column, digits: int) -> Column:
    """Rounds half up at ``digits`` decimals."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero or empty vectors, null for unequal lengths, within [-1, 1]."""
    size = norm(a) * norm(b)
    value = F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), value)


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) > 0, x / norm(a)).otherwise(x.cast("double")))


def recency(latest_seconds: Column, now_seconds: Column, hours: float = 168.0) -> Column:
    return F.exp(-(now_seconds - latest_seconds) / 3600.0 / hours)


def rank_boost(rank: Column) -> Column:
    return F.when(rank <= 0, 0.0).otherwise(1.0 / (1.0 + F.log(F.greatest(rank, F.lit(1)).cast("double"))))


def graph_boost(degree: Column) -> Column:
    return F.least(F.lit(0.3), F.log(1.0 + degree) * 0.15)


def access_boost(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log(1.0 + count) * 0.2)


def feedback_norm(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1.0) / 2.0))


def risk_boost(risk: Column, operational: Column) -> Column:
    """Nothing for a kind without a risk."""
    from loam.schemas import lookup

    base = F.coalesce(lookup(RISK_BOOST, risk), F.lit(0.0))
    return F.when(F.coalesce(operational, F.lit(False)) & risk.isin("critical", "high"), F.least(F.lit(1.0), base * 1.5)).otherwise(base)


def composite(factors: dict[str, Column], profile: str = "default") -> Column:
    """Weighted sum of the factors, 4 decimals."""
    weights = dict(zip(FACTORS, PROFILES[profile], strict=True))
    total = F.lit(0.0)
    for name in FACTORS:
        part = factors[name] * weights[name]
        total = total - part if name == "specificity" else total + part
    return half_up(total, 4)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def term_overlap(text: Column, terms: Column) -> Column:
    """Share of the terms that the text contains."""
    low = F.lower(text)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)).otherwise(0.0)
