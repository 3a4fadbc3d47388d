"""Scoring constants. They are put into plans as literals, never joined."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


def _weights() -> dict[str, float]:
    return {"meeting": 3.0, "event": 2.0, "rsvp": 1.2, "invite": 0.6, "cohort": 0.5, "email": 2.5, "doc": 1.5, "note": 1.5, "record": 1.0}


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] = field(default_factory=_weights)
    email_cc: float = 1.0
    mentioned_factor: float = 0.5
    half_life_days: float = 180.0
    saturation: float = 6.0
    max_participants: int = 50
    auto_merge: float = 0.95
    review: float = 0.70
    overdue_ratio: float = 1.5
    cold_ratio: float = 3.0
    dormant_days: int = 180
    private_hop_strength: float = 0.5
    hide_private_entities: bool = True
    undated_decay: float = 0.7
    least_strength: float = 0.01

    def __post_init__(self) -> None:
        if not 0 < self.review < self.auto_merge <= 1:
            raise ValueError("review must be below auto_merge, both within 0 and 1")
        if not 1 <= self.overdue_ratio < self.cold_ratio:
            raise ValueError("overdue_ratio must be below cold_ratio")
        if min([self.half_life_days, self.saturation, self.max_participants, *self.weights.values()]) <= 0:
            raise ValueError("weights, half life, saturation and the participant cap must be positive")

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def changed(self, **patch) -> Settings:
        """A copy with some settings changed; weights are merged with what there is."""
        unknown = set(patch) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if "weights" in patch:
            patch["weights"] = self.weights | patch["weights"]
        return replace(self, **patch)


def visible_layers(viewer: str | None) -> list[str]:
    """The privacy layers a viewer reads: the shared one, and their own."""
    return [""] if not viewer else ["", viewer]


def next_due(last: float, interval: float, failures: int = 0) -> float:
    """When a source is due again, in seconds: each failure in a row doubles the wait, up to a day or the interval if that is longer."""
    return last + min(interval * 2 ** min(failures, 4), max(interval, 86_400.0))
