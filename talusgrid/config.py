"""Tunable constants of the retrieval engine, as values that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bm25:
    """The usual saturation and length parameters."""

    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Depth:
    """How many candidates each list gives and how many results are kept."""

    vector: int
    lexical: int
    final: int


#: Depths by query kind; the third number for confident classifications differs.
DEPTHS = {
    "factual": (Depth(8, 8, 8), Depth(8, 8, 6)),
    "interpretive": (Depth(15, 10, 15), Depth(15, 10, 12)),
    "hybrid": (Depth(12, 10, 10), Depth(12, 10, 10)),
    "default": (Depth(10, 8, 10), Depth(10, 8, 10)),
}


def depth(kind: str, confidence: float) -> Depth:
    usual, confident = DEPTHS.get(kind, DEPTHS["default"])
    return confident if confidence > 0.8 else usual


@dataclass(frozen=True)
class Fusion:
    """Rank fusion, boosts, penalties, de-duplication and diversification."""

    rank_constant: int = 60
    widening: int = 4
    keyword_step: float = 0.15
    speaker_boost: float = 1.3
    group_boost: float = 1.5
    boilerplate_two: float = 0.3
    boilerplate_one: float = 0.6
    jaccard: float = 0.6
    group_cap: int = 2
    target_cap_factor: int = 3
    dense_cap_factor: int = 2
    dense_hits: int = 3
    dense_share: float = 0.3
    neighbour_factor: float = 0.5
    inject_min_similarity: float = 0.15
    inject_cap: int = 3
    inject_pool: int = 6
    inject_targets: int = 3
    inject_enough: int = 3
    topic_discount: float = 0.85
    supplemental_discount: float = 0.7


FUSION = Fusion()
