"""Settings of an index and of its queries."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class IndexSettings:
    sample_size: int = 40_000  # values whose types are counted; 0: all
    polarized: bool = True
    views: bool = True
    statistics_steps: int = 3

    def fingerprint(self) -> str:
        """Changes if an index has to be built again."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class QuerySettings:
    max_clauses: int = 50_000
    max_results: int = 100
    views: bool = True
    fractions: bool = True
    penalty_weight: float = 0.1
    frequency_weight: float = 2.7
    distance_weight: float = 0.2
    doc_boost: float = 0.1
    cutoff: float = 0.8
    explain: bool = False

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} must not be negative")


@dataclass(frozen=True)
class NeutralSettings:
    """The language-neutral engine's weights, and the patterns that tell top, bottom and functions of a language."""

    top: str = "Any"
    bottom: str = "Nothing"
    function: str = r"(Fn[0-9]+)|((<memberAccess|<methodInvocation)[0-9]*>)"
    distance_weight: float = 0.05
    frequency_weight: float = 2.0
    cutoff: float = 5.0
    penalty_weight: float = 0.05
