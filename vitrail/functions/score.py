"""Similarity scores of image descriptors, the colour gate and the hybrid score.

A null score means that a descriptor is missing: it takes its weight out of the hybrid score. Scores are doubles in [0, 1].
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrail.functions.vector import EPSILON


@dataclass(frozen=True)
class SimilaritySettings:
    """Weights of the components and limits of the colour gate, in per cent. The defaults are fixed values."""

    clip_weight: float = 44.0
    color_distribution_weight: float = 31.0
    texture_weight: float = 20.0
    dominant_color_weight: float = 5.0
    strict_color_rejection: bool = True
    min_color_distribution_match: float = 30.0
    max_dominant_color_difference: float = 30.0


def clamp01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit hashes."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def histogram_intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller values; 0 for unequal or no length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, v: s + v)
    whole = F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(clamp01(total))
    return F.when(a.isNotNull() & b.isNotNull(), whole)


def _segments(a: Column, b: Column, bounds: list[tuple[int, int]]) -> Column:
    parts = [histogram_intersection(F.slice(a, s + 1, e - s), F.slice(b, s + 1, e - s)) for s, e in bounds]
    return clamp01(reduce(lambda x, y: x + y, parts) / len(parts))


def texture_similarity(a: Column, b: Column) -> Column:
    """Mean of the gradient part (2 x 8 bins) and the pattern part (2 x 16 bins); null unless both have 48 values."""
    both = (F.size(a) == 48) & (F.size(b) == 48)
    gradient, pattern = _segments(a, b, [(0, 8), (8, 16)]), _segments(a, b, [(16, 32), (32, 48)])
    return F.when(a.isNotNull() & b.isNotNull() & both, (gradient + pattern) / 2)


def gradient_similarity(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 48) & (F.size(b) == 48), _segments(a, b, [(0, 8), (8, 16)]))


def pattern_similarity(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 48) & (F.size(b) == 48), _segments(a, b, [(16, 32), (32, 48)]))


def blend_texture_and_hash(hash_score: Column, texture: Column) -> Column:
    """65 parts texture to 35 hash, but no less than 0.92 of the hash; one alone stands for both; null without either."""
    blended = F.greatest(0.35 * hash_score + 0.65 * texture, 0.92 * hash_score)
    return clamp01(F.coalesce(F.when(hash_score.isNotNull() & texture.isNotNull(), blended), hash_score, texture))


def rgb_similarity(a: Column, b: Column) -> Column:
    """1 less the distance of two colours as a share of the greatest."""
    square = reduce(lambda x, y: x + y, [(a[c] - b[c]).cast("double") * (a[c] - b[c]) for c in "rgb"])
    return clamp01(1 - F.sqrt(square) / (255 * 3**0.5))


def redmean_distance(a: Column, b: Column) -> Column:
    """Distance of two colours weighted by their mean red, over 765, at most 1."""
    red = (a["r"] + b["r"]) * 0.5
    d = {c: (a[c] - b[c]).cast("double") for c in "rgb"}
    square = (2 + red / 256) * d["r"] * d["r"] + 4 * d["g"] * d["g"] + (2 + (255 - red) / 256) * d["b"] * d["b"]
    return clamp01(F.sqrt(square) / 765)


def passes_color_gate(histogram: Column, dominant: Column, settings: SimilaritySettings) -> Column:
    """Whether a row may be scored; a missing histogram isn't held against it."""
    if not settings.strict_color_rejection:
        return F.lit(True)
    histogram_fails = F.coalesce(histogram * 100 < settings.min_color_distribution_match, F.lit(False))
    return ~histogram_fails & (clamp01(1 - dominant) * 100 <= settings.max_dominant_color_difference)


def hybrid_score(hash_score: Column, histogram: Column, clip: Column, dominant: Column, settings: SimilaritySettings) -> Column:
    """Weighted mean of the scores that are there; 0 without weight. Components without weight don't enter the plan."""
    parts = [
        (max(settings.dominant_color_weight, 0.0), dominant),
        (max(settings.color_distribution_weight, 0.0), histogram),
        (max(settings.texture_weight, 0.0), hash_score),
        (max(settings.clip_weight, 0.0), clip),
    ]
    used = [(w, s) for w, s in parts if w > 0]
    if not used:
        return F.lit(0.0)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.lit(w) * s, F.lit(0.0)) for w, s in used])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, s in used])
    return F.when(weight <= EPSILON, F.lit(0.0)).otherwise(clamp01(total / weight))


def ratio(part: Column, whole: Column) -> Column:
    """0 if there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
