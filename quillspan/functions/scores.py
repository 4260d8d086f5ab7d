"""Score arithmetic. Sums keep one order of addition, so results agree to the last digit."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_scale(v: Column, cap: float) -> Column:
    """0 for nothing, rising with the logarithm to 1 at cap."""
    return F.when(v > 0, F.least(F.log1p(v.cast("double")) / math.log1p(cap), F.lit(1.0))).otherwise(0.0)


def safe_norm(v: Column, most: Column) -> Column:
    """v as a part of most between 0 and 1; 0 if most isn't positive."""
    return F.when(most > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double") / most.cast("double")))).otherwise(0.0)


def share_of(hits: Column, full: int) -> Column:
    """A number of hits as a part of those that count in full, 1 at most."""
    return F.least(hits / F.lit(float(full)), F.lit(1.0))


#: What each part of a record's score weighs, and the caps of its engagement counts.
WEIGHTS: Mapping[str, float] = {"priority": 32, "novelty": 22, "general": 20, "engineering": 14, "research": 8}
BOOST = 10
ENGAGEMENT = (("points", 14, 1200), ("comments", 10, 800), ("upvotes", 10, 5000))
PRIORITY = {"high": 1.0, "medium": 0.65, "low": 0.35}


def priority_score(c: Column) -> Column:
    out = F.when(c == "high", PRIORITY["high"])
    return out.when(c == "low", PRIORITY["low"]).otherwise(PRIORITY["medium"])


def record_score(parts: Mapping[str, Column], boost: Column, engagement: Mapping[str, Column]) -> Column:
    """The weighted sum of parts, boost and engagement, rounded to three digits."""
    total: Column = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + w * parts[name]
    total = total + F.when(boost, float(BOOST)).otherwise(0.0)
    for name, w, cap in ENGAGEMENT:
        total = total + w * log_scale(engagement[name], cap)
    return F.round(total, 3)


def reasons(parts: Mapping[str, Column], boost: Column, engagement: Mapping[str, Column]) -> Column:
    """Why a record scored as it did, one line a part that is shown."""
    fixed = [F.format_string(f"{name}: %.3f", parts[name].cast("double")) for name in WEIGHTS]
    seen = [F.when(engagement[name] > 0, F.format_string(f"{name}: %.0f", engagement[name].cast("double"))) for name, _, _ in ENGAGEMENT]
    return F.array_compact(F.array(*fixed, F.when(boost, F.lit("boost")), *seen))


#: Weights of the trend score.
TREND = {"growth": 0.55, "stars": 0.25, "activity": 0.10, "forks": 0.10}
