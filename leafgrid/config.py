"""Settings: typed values with lenient reading, checked together, that plans take as literals."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
STRATEGIES = ("weighted_nms", "voting", "cascade")


def as_bool(value: object, default: bool) -> bool:
    """A truth value, or a word for one; the default for anything else."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    return True if word in TRUE else False if word in FALSE else default


def as_number(value: object, default: float, kind: type = float) -> float:
    """A number or the text of one; the default for anything else."""
    try:
        return kind(str(value).strip()) if kind is int else float(str(value).strip())
    except ValueError:
        return default


def as_text(value: object, default: str) -> str:
    text = "" if value is None else str(value).strip()
    return text or default


def _shares() -> dict[str, float]:
    return {"detection": 0.30, "content": 0.25, "boundary": 0.20, "caption": 0.15, "position": 0.10}


@dataclass(frozen=True)
class Settings:
    """What the detection pipeline can be told. The values here are those it has without a file."""

    doclayout_confidence: float = 0.5
    table_transformer_confidence: float = 0.7
    legacy_confidence: float = 0.5
    min_classification_confidence: float = 0.3
    nms_iou_threshold: float = 0.5
    merge_iou_threshold: float = 0.3
    merge_distance_threshold: float = 50.0
    min_quality_score: float = 0.4
    fusion_strategy: str = "weighted_nms"
    enable_visual_merge: bool = True
    max_workers: int = 4
    detector_weights: dict[str, float] = field(default_factory=dict)
    quality_weights: dict[str, float] = field(default_factory=_shares)

    def problems(self) -> list[str]:
        """What is wrong with the settings, by name; nothing for good ones."""
        out = []
        for name in ("doclayout_confidence", "table_transformer_confidence", "legacy_confidence", "min_classification_confidence", "nms_iou_threshold", "merge_iou_threshold", "min_quality_score"):
            if not 0 <= getattr(self, name) <= 1:
                out.append(f"{name} must lie between 0 and 1")
        if self.fusion_strategy not in STRATEGIES:
            out.append(f"fusion_strategy must be one of {', '.join(STRATEGIES)}")
        for group in ("detector_weights", "quality_weights"):
            out += [f"{group}.{k} must lie between 0 and 1" for k, v in getattr(self, group).items() if not 0 <= v <= 1]
        if self.quality_weights and abs(sum(self.quality_weights.values()) - 1) > 0.01:
            out.append("quality_weights must sum to 1")
        if self.merge_distance_threshold < 0:
            out.append("merge_distance_threshold must not be negative")
        if self.max_workers < 1:
            out.append("max_workers must be at least 1")
        return out

    def __post_init__(self) -> None:
        wrong = self.problems()
        if wrong:
            raise ValueError("; ".join(wrong))

    @classmethod
    def read(cls, values: dict) -> Settings:
        """Settings of a dict: unknown names are left out, values that cannot be read keep their default."""
        base = cls()
        known = {}
        for f in fields(cls):
            if f.name not in values:
                continue
            given, default = values[f.name], getattr(base, f.name)
            if isinstance(default, bool):
                known[f.name] = as_bool(given, default)
            elif isinstance(default, (int, float)):
                known[f.name] = as_number(given, default, type(default))
            elif isinstance(default, dict):
                known[f.name] = {str(k).lower(): as_number(v, default.get(str(k).lower(), 0.5)) for k, v in given.items()} if isinstance(given, dict) else default
            else:
                known[f.name] = as_text(given, default)
        return replace(base, **known)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls.read(json.load(f))

    def as_dict(self) -> dict:
        return asdict(self)
