"""Rule sets that the operators turn into Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from modloom.domains import CLASS_NAMES, SEVERITY_NAMES


@dataclass(frozen=True)
class TextRules:
    min_chars: int = 3
    max_repeat: int = 3


@dataclass(frozen=True)
class SplitRules:
    folds: int = 10
    val_fold: int = 1
    test_fold: int = 0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.val_fold == self.test_fold:
            raise ValueError("the validation fold and the test fold must be different")
        for fold in (self.val_fold, self.test_fold):
            if not 0 <= fold < self.folds:
                raise ValueError(f"fold {fold} is not one of the {self.folds} folds")


@dataclass(frozen=True)
class ScoreRule:
    """``column >= minimum``, or ``column > minimum`` when not inclusive."""

    column: str
    minimum: float
    inclusive: bool = True

    @classmethod
    def from_mapping(cls, raw: Mapping) -> ScoreRule:
        if "min" in raw:
            return cls(raw["column"], float(raw["min"]), True)
        return cls(raw["column"], float(raw["min_exclusive"]), False)


@dataclass(frozen=True)
class LabelRules:
    # The shipped class rules.
    priority: tuple[str, ...] = ("threat", "hate", "offensive", "neither")
    flags: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "threat": ("threat",),
            "hate": ("identity_hate",),
            "offensive": ("toxic", "severe_toxic", "obscene", "insult"),
        }
    )
    scores: Mapping[str, ScoreRule] = field(
        default_factory=lambda: {
            "threat": ScoreRule("m_violence", 2.5),
            "hate": ScoreRule("m_hate_speech_score", 0.5, inclusive=False),
            "offensive": ScoreRule("m_insult", 2.5),
        }
    )
    min_class_share: float = 0.02

    def __post_init__(self) -> None:
        if sorted(self.priority) != sorted(CLASS_NAMES):
            raise ValueError(f"priority must list each of {CLASS_NAMES} once")

    @classmethod
    def from_mapping(cls, raw: Mapping) -> LabelRules:
        """Accepts the parsed label-map file: priority, jigsaw, mhs, min_class_share."""
        return cls(
            priority=tuple(raw["priority"]),
            flags={name: tuple(columns) for name, columns in raw["jigsaw"].items()},
            scores={name: ScoreRule.from_mapping(rule) for name, rule in raw["mhs"].items()},
            min_class_share=float(raw["min_class_share"]),
        )


# The thresholds a level may have, the signal of each, and whether its edge counts.
LEVEL_FIELDS = (
    ("genocide_min", "m_genocide", True),
    ("violence_min", "m_violence", True),
    ("hate_speech_score_exclusive_min", "m_hate_speech_score", False),
    ("dehumanize_min", "m_dehumanize", True),
    ("insult_min", "m_insult", True),
)


@dataclass(frozen=True)
class LevelRule:
    """Any of up to five optional thresholds; unset ones never match."""

    genocide_min: float | None = None
    violence_min: float | None = None
    hate_speech_score_exclusive_min: float | None = None
    dehumanize_min: float | None = None
    insult_min: float | None = None

    def conditions(self) -> list[ScoreRule]:
        found = []
        for name, column, inclusive in LEVEL_FIELDS:
            limit = getattr(self, name)
            if limit is not None:
                found.append(ScoreRule(column, limit, inclusive))
        return found


@dataclass(frozen=True)
class SeverityRules:
    # The shipped severity rubric.
    weights: Mapping[str, int] = field(
        default_factory=lambda: {
            "toxic": 1,
            "obscene": 1,
            "insult": 1,
            "identity_hate": 2,
            "threat": 2,
            "severe_toxic": 3,
        }
    )
    bins: Mapping[str, tuple[int, int]] = field(
        default_factory=lambda: {
            "low": (1, 2),
            "medium": (3, 4),
            "high": (5, 6),
            "critical": (7, 999),
        }
    )
    critical: LevelRule = LevelRule(genocide_min=1.0, violence_min=3.0)
    high: LevelRule = LevelRule(hate_speech_score_exclusive_min=2.0, dehumanize_min=2.5)
    medium: LevelRule = LevelRule(hate_speech_score_exclusive_min=0.5, insult_min=3.0)
    min_level_share: float = 0.03

    def __post_init__(self) -> None:
        if set(self.bins) != set(SEVERITY_NAMES):
            odd = sorted(set(self.bins) ^ set(SEVERITY_NAMES))
            raise ValueError(f"every severity level needs one score range; check {odd}")

    @classmethod
    def from_mapping(cls, raw: Mapping) -> SeverityRules:
        """Accepts the parsed severity file: jigsaw, mhs, min_level_share."""
        levels = {
            name: LevelRule(**{key: float(value) for key, value in raw["mhs"][name].items()})
            for name in ("critical", "high", "medium")
        }
        return cls(
            weights={name: int(value) for name, value in raw["jigsaw"]["weights"].items()},
            bins={name: (int(lo), int(hi)) for name, (lo, hi) in raw["jigsaw"]["bins"].items()},
            min_level_share=float(raw["min_level_share"]),
            **levels,
        )


TEXT_RULES = TextRules()
SPLIT_RULES = SplitRules()
LABEL_RULES = LabelRules()
SEVERITY_RULES = SeverityRules()
