"""Thresholds and caps of a screening run."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MatchConfig:
    """A profile of the decision rules; every field is a literal in the plans that use it."""

    exact_block: float = 1.0
    compact_block: float = 1.0  # above the compact score, so compact matches are reviewed
    fuzzy_block: float = 0.8
    fuzzy_min_length: int = 6
    review: float = 0.75
    candidates: int = 5
    reserved_slots: int = 2
    pool: int = 100
    short_length: int = 3
    short_fuzzy_block: float = 1.01
    transliteration_block: float = 0.98
    cross_floor: float = 0.55
    cross_evidence: float = 0.72
    skeleton_evidence_length: int = 5
    display: float = 0.75
    phonetic_pool: int = 300


DEFAULT = MatchConfig()
#: The review threshold at which one-letter slips in five- and six-letter names are still held for review.
CALIBRATED = replace(DEFAULT, review=0.68)
PROFILES = {"default": DEFAULT, "calibrated": CALIBRATED}
