"""Thresholds, re-ranking and quality scores."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Threshold:
    """How a similarity threshold follows the distribution of scores (fixed values by content type below)."""

    multiplier: float
    low: float
    high: float
    default: float
    min_samples: int
    rate: float = 0.1


THRESHOLDS = {
    "code": Threshold(0.7, 0.2, 0.85, 0.4, 3, 0.15),
    "doc": Threshold(0.4, 0.15, 0.75, 0.35, 5, 0.1),
    "config": Threshold(0.6, 0.18, 0.8, 0.38, 4, 0.12),
    "other": Threshold(0.5, 0.1, 0.8, 0.3, 5, 0.1),
}


def threshold(n: Column, mean: Column, std: Column, p: Threshold) -> Column:
    """Mean plus a multiple of the population deviation, within bounds; the default for too few scores."""
    return F.when(n < max(1, p.min_samples), p.default).otherwise(F.least(F.greatest(mean + p.multiplier * std, F.lit(p.low)), F.lit(p.high)))


@dataclass
class AdaptiveThreshold:
    """Multiplier that follows past rounds: ordered state, kept on the driver, off unless asked for."""

    params: Threshold
    history: list[tuple[float, float, float]] = field(default_factory=list)
    multiplier: float | None = None
    samples: int = 0

    def update(self, n: int, mean: float, std: float) -> float:
        """Take a round's distribution; return its threshold."""
        m = self.multiplier if self.multiplier is not None else self.params.multiplier
        t = self.params.default if n < max(1, self.params.min_samples) else min(max(mean + m * std, self.params.low), self.params.high)
        self.samples += n
        self.history = [*self.history, (mean, std, t)][-100:]
        if self.samples >= 20 and len(self.history) >= 10:
            means, stds, past = (sum(x) / len(x) for x in zip(*self.history))
            if means and stds and abs(mean - means) / means < 0.2 and abs(std - stds) / stds < 0.3 and t:
                self.multiplier = min(max(m * (1 + (past / t - 1) * self.params.rate), 0.2), 1.5)
        return t

    def stats(self) -> dict:
        """How many scores and rounds there were, the multiplier in use, and means over the rounds that are kept."""
        means = [sum(x) / len(x) for x in zip(*self.history)] or [None] * 3
        now = self.multiplier if self.multiplier is not None else self.params.multiplier
        return {"samples": self.samples, "rounds": len(self.history), "multiplier": now, **dict(zip(("mean", "std", "threshold"), means, strict=True))}

    def reset(self) -> None:
        self.history, self.multiplier, self.samples = [], None, 0


@dataclass(frozen=True)
class RerankWeights:
    """Weights of a result's parts; normalised where they are used (fixed values)."""

    similarity: float = 0.7
    freshness: float = 0.15
    content_type: float = 0.05
    role: float = 0.05
    size: float = 0.03
    language: float = 0.02


def days_between(earlier: Column, later: datetime | Column) -> Column:
    end = later if isinstance(later, Column) else F.lit(later)
    return (F.unix_micros(end) - F.unix_micros(earlier)) / 86_400_000_000.0


def reranked(score: Column, updated_at: Column, size: Column, content_type: Column, role: Column, language: Column, now: Column, types=("code", "doc"), roles=("core", "helper"), languages=("typescript", "javascript", "python"), w: RerankWeights = RerankWeights()) -> Column:
    """Weighted sum of similarity, freshness, size and preferred type, role and language; missing metadata adds nothing."""
    total = w.similarity + w.freshness + w.content_type + w.role + w.size + w.language
    liked = lambda c, of: F.when(c.isin(list(of)), 1.0).when(c.isNotNull(), 0.5).otherwise(0.0)
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - days_between(updated_at, now) / 365), F.lit(0.0))
    big = F.when(size > 0, F.least(F.lit(1.0), size / 1048576)).otherwise(0.0)
    parts = w.similarity * score + w.freshness * fresh + w.content_type * liked(content_type, types) + w.role * liked(role, roles) + w.size * big + w.language * liked(language, languages)
    return parts / total


def quality_score(comment_percent: Column, atomic: Column, relations: Column, tokens: Column) -> Column:
    q = 50 + F.when(comment_percent > 20, 20).when(comment_percent > 10, 10).otherwise(0) + F.when(atomic, 15).otherwise(0) + F.least(5 * relations, F.lit(15)) - F.when(tokens > 1000, 10).otherwise(0)
    return F.least(F.greatest(q, F.lit(0)), F.lit(100))


def relevance_score(important: Column, complexity: Column, density: Column) -> Column:
    r = 60 + F.when(important, 20).otherwise(0) + F.when(complexity.between(3, 7), 10).otherwise(0) + F.when(density.between(5, 15), 10).otherwise(0)
    return F.least(F.greatest(r, F.lit(0)), F.lit(100))


def ab_relevance(type_expected: Column, keywords_found: Column, score: Column, age_days: Column) -> Column:
    """Points of a result in a comparison of two search set-ups, at most 100."""
    points = F.when(type_expected, 30.0).otherwise(0.0) + 10.0 * keywords_found + F.least(F.lit(20.0), 20 * score) + F.when(age_days < 30, 10.0).when(age_days < 90, 5.0).otherwise(0.0)
    return F.least(points, F.lit(100.0))


def routed_model(content_type: Column, models: dict[str, str], fallback: str) -> Column:
    """The embedding model of a content type."""
    t = F.lower(content_type)
    kinds = {"code": ["code", "source", "program"], "text": ["doc", "text", "documentation", "markdown", "readme"], "config": ["config", "configuration", "json", "yaml", "toml", "ini"]}
    out = F.lit(fallback)
    for kind, names in kinds.items():
        out = F.when(t.isin(names), models[kind]).otherwise(out)
    return out
