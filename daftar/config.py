"""Every tunable number of the document-date engine, passed explicitly to operators.

The defaults are fixed values: results depend on them, so they have to be these.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CalendarRange:
    """Years accepted for a birth date (Solar Hijri)."""

    min_year: int = 1290
    max_year: int = 1410


@dataclass(frozen=True)
class Acceptance:
    is_date: float = 0.5
    date_prob: float = 0.6
    confidence: float = 60.0
    confident_prob: float = 0.8
    skip_second_pass: float = 80.0


@dataclass(frozen=True)
class Selection:
    cutoff_year: int = 1400
    takeover_gap: float = 15.0
    row_gap: float = 0.015
    lone_y: float = 0.65
    tight_width: int = 800
    tight_height: int = 400
    tight_aspect: float = 2.2
    full_strip: int = 140
    row_margin: float = 0.02


@dataclass(frozen=True)
class Anchor:
    start: float = 0.35
    span: float = 0.6
    right_weight: float = 0.7
    width_weight: float = 0.3
    min_width: float = 0.12
    max_width: float = 0.75
    off_width: float = 0.25


@dataclass(frozen=True)
class Lines:
    band: tuple[float, float, float, float] = (0.08, 0.18, 0.99, 0.93)  # x0 y0 x1 y1
    ideal_y: float = 0.52
    min_height: int = 18
    max_height: int = 84
    min_width: int = 90
    min_aspect: float = 2.2
    max_width_fraction: float = 0.9
    pad_x: float = 0.25
    pad_y: float = 0.30
    roi_pad_x: int = 10
    roi_pad_y: int = 13
    merge_widths: tuple[int, ...] = (23, 21, 33, 40)
    merge_height: int = 5
    overlap: float = 0.6
    keep: int = 18
    blur: int = 3
    block: int = 31
    offset: float = 12.0


@dataclass(frozen=True)
class Augment:
    top: int = 4
    #: dx, dy as shares of the box, and growth.
    variants: tuple[tuple[float, float, float], ...] = ((-0.1, 0.0, 0.1), (0.1, 0.0, 0.1), (0.0, -0.05, 0.12), (0.0, 0.05, 0.16))
    invalid_penalty: float = 0.8


@dataclass(frozen=True)
class Shape:
    ink: int = 128
    row_share: float = 0.12
    min_run: int = 2
    merge_gap: int = 2
    zero_max: float = 0.70
    five_min: float = 0.55
    nine_center: float = 0.55
    five_low: float = 0.3
    five_high: float = 0.7
    one_aspect: float = 0.40
    stem_ratio: float = 1.5
    stem_min: int = 2
    stem_five: int = 12
    conflict_scale: float = 0.5
    min_hole: int = 2
    compare_width: int = 24
    compare_height: int = 32


@dataclass(frozen=True)
class Card:
    width: int = 1200
    height: int = 756
    max_side: int = 1600
    blur: int = 5
    edge_low: int = 45
    edge_high: int = 140
    close: int = 5
    min_area: float = 0.28
    min_aspect: float = 1.25
    max_aspect: float = 2.05
    epsilon: float = 0.02


@dataclass(frozen=True)
class Gray:
    lift: int = 8
    gain: float = 1.12
    invert_below: float = 110.0
    dark_below: float = 100.0
    flat_below: float = 38.0
    soft_below: float = 65.0
    unsharp_sigma: float = 1.2
    unsharp_gain: float = 1.5


@dataclass(frozen=True)
class ModelInput:
    height: int = 32
    width: int = 160
    slots: int = 8
    epsilon: float = 1e-6
    min_width: int = 8


@dataclass(frozen=True)
class Config:
    calendar: CalendarRange = field(default_factory=CalendarRange)
    acceptance: Acceptance = field(default_factory=Acceptance)
    selection: Selection = field(default_factory=Selection)
    anchor: Anchor = field(default_factory=Anchor)
    lines: Lines = field(default_factory=Lines)
    augment: Augment = field(default_factory=Augment)
    shape: Shape = field(default_factory=Shape)
    card: Card = field(default_factory=Card)
    gray: Gray = field(default_factory=Gray)
    model: ModelInput = field(default_factory=ModelInput)
    required_votes: int = 2


DEFAULT = Config()
