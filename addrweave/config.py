"""Settings of the matcher."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds and the number of candidates kept.

    A threshold outside (0, 1) or a number outside 1 to 16 gives the default.
    ``clamp_confidence`` holds confidences at 1.0, so a full match by key stays
    ``canonical``; without it the plain sums of doubles are compared.
    """

    structured_min: float = 0.65
    fuzzy_min: float = 0.55
    rerank_min: float = 0.70
    max_candidates: int = 5
    clamp_confidence: bool = True

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            ok = {"max_candidates": lambda v: isinstance(v, int) and 1 <= v <= 16, "clamp_confidence": lambda v: isinstance(v, bool)}.get(f.name, lambda v: isinstance(v, float) and 0 < v < 1)
            if not ok(value):
                object.__setattr__(self, f.name, f.default)

    @classmethod
    def from_mapping(cls, values: Mapping[str, str], prefix: str = "") -> MatchConfig:
        """Settings from texts such as ``os.environ``; names are those of the fields, upper-cased, behind the prefix.

        What is missing, no number or out of range gives the default.
        """
        found = {}
        for f in fields(cls):
            text = values.get(f"{prefix}{f.name.upper()}")
            if text is not None:
                try:
                    found[f.name] = text.lower() == "true" if isinstance(f.default, bool) else type(f.default)(text)
                except ValueError:
                    continue
        return cls(**found)
