"""The parameters of the ranking, in one frozen set."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType


def _fixed(**values: float) -> Mapping[str, float]:
    return field(default_factory=lambda: MappingProxyType(values))


@dataclass(frozen=True)
class Gate:
    """Opens from ``floor`` ratings (closed) to ``full`` (open)."""

    floor: int
    full: int


# The defaults of the ranking.
@dataclass(frozen=True)
class Ranking:
    target: int = 20
    hard_most: int = 28
    triage_most: int = 800
    deep_keep: int = 120
    shortlist_keep: int = 60
    exploration: int = 5
    semantic_min_words: int = 300
    triage_quota: int = 60
    interest_quota: int = 20
    knn_quota: int = 20
    look_back_days: int = 180
    half_life_days: float = 60.0
    neighbours: int = 5
    negative_coefficient: float = 0.75
    knn_gate: Gate = Gate(8, 25)
    feed_gate: Gate = Gate(15, 40)
    affinity_gate: Gate = Gate(15, 40)
    slop_author_penalty: float = 0.75
    cluster_threshold: float = 0.85
    per_cluster: int = 2
    protected: int = 10
    preliminary: Mapping[str, float] = _fixed(interest=0.30, knn=0.25, affinity=0.10, heuristic=0.20, feed=0.10, social=0.05)
    utility: Mapping[str, float] = _fixed(quality=0.40, fit=0.20, knn=0.10, affinity=0.05, interest=0.10, feed=0.05, triage=0.05, social=0.03, heuristic=0.02)

    def problems(self) -> list[str]:
        """What is wrong with the set, in words; empty if nothing is."""
        gates = {"knn": self.knn_gate, "feed": self.feed_gate, "affinity": self.affinity_gate}
        rules = [
            (self.target > 0, "target must be positive"),
            (self.hard_most >= self.target, "hard_most must not be below target"),
            (self.deep_keep >= self.shortlist_keep >= self.target, "deep_keep >= shortlist_keep >= target must hold"),
            *[(g.full > g.floor >= 0, f"the {name} gate must be full above its floor") for name, g in gates.items()],
            (0 <= self.slop_author_penalty <= 1, "slop_author_penalty must lie between 0 and 1"),
            (0 <= self.cluster_threshold <= 1, "cluster_threshold must lie between 0 and 1"),
            (self.per_cluster >= 1, "per_cluster must be 1 at least"),
            (math.isfinite(self.half_life_days) and self.half_life_days > 0, "half_life_days must be positive"),
            (min(self.triage_quota, self.interest_quota, self.knn_quota, self.exploration) >= 0, "quotas must not be negative"),
            (all(math.isfinite(w) and w >= 0 for ws in (self.preliminary, self.utility) for w in ws.values()), "weights must be finite and not negative"),
        ]
        return [text for holds, text in rules if not holds]

    def validate(self) -> Ranking:
        found = self.problems()
        if found:
            raise ValueError("; ".join(found))
        return self


RANKING = Ranking().validate()
