"""Strategies, sensitivities and what they stand for."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on each of them.
FONT_RATIO = {"low": 1.5, "medium": 1.3, "high": 1.2}
LEAST_CONFIDENCE = {"low": 0.8, "medium": 0.6, "high": 0.4}
HEADING_LEVELS = {"low": 1, "medium": 2, "high": 3}
HEADING_CONFIDENCE = {1: 1.0, 2: 0.7, 3: 0.5}
MANIFEST_CONFIDENCE = 0.6
PDF_STRATEGIES = ("bookmarks", "heuristic", "hybrid")
EPUB_STRATEGIES = ("native", "structural", "manifest", "hybrid")


@dataclass(frozen=True)
class Thresholds:
    ratio: float
    least: float


def thresholds(sensitivity: str) -> Thresholds:
    """An unknown sensitivity is medium."""
    key = sensitivity if sensitivity in FONT_RATIO else "medium"
    return Thresholds(FONT_RATIO[key], LEAST_CONFIDENCE[key])


def heading_depth(sensitivity: str) -> int:
    return HEADING_LEVELS.get(sensitivity, 2)


def choice(value: str, allowed: tuple[str, ...]) -> str:
    """A command-line choice, whatever its case."""
    low = value.lower()
    if low not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return low
