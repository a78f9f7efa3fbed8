"""Thresholds of classification, merging and layout.

Fixed values: results depend on each of them, so they are kept in one place and can be replaced by a copy.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # Lines into blocks
    indent_split: float = 20.0
    default_font: str = "helv"
    default_size: float = 10.0
    # Kinds
    short_text: int = 80
    heading_size: float = 18.0
    heading_words: int = 14
    heading_upper: int = 60
    toc_text: int = 120
    # Merging
    column_shift: float = 20.0
    least_gap: float = -2.0
    gap_ratio: float = 1.6
    gap_floor: float = 24.0
    gap_size: float = 12.0
    font_size_shift: float = 1.5
    # Requests
    chars_per_token: int = 4
    max_output_tokens: int = 4096
    max_input_chars: int = 70000
    least_input_chars: int = 1000
    # Capacity of a block
    capacity_floor: float = 8.0
    capacity_text: float = 0.6
    # Layout
    overlap_ratio: float = 0.3
    decorative_chars: int = 12
    decorative_area: float = 0.20
    decorative_tall_chars: int = 8
    decorative_height: float = 0.45
    neighbor_gap: float = 20.0
    neighbor_padding: float = 10.0
    right_margin: float = 24.0
    widen_ratio: float = 1.35
    widen_by: float = 120.0
    least_width: float = 20.0
    least_height: float = 4.0
    paragraph_pad: tuple = (0.16, 3.0, 14.0)
    list_pad: tuple = (0.10, 2.0, 8.0)
    justify_width: float = 0.45
    body_lines: int = 2
    body_chars: int = 40
    body_width: float = 0.18
    body_size_floor: float = 18.0
    body_size_ratio: float = 0.03
    column_x: float = 36.0
    column_width: float = 0.35
    column_percentile: float = 0.25
    # Fitting a font size
    least_size: float = 3.0
    size_headroom: float = 1.05
    fit_steps: int = 12
    fit_delta: float = 0.05


DEFAULTS = Thresholds()
