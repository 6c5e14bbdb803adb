"""Settings that define results, in one immutable record, with JSON files for overrides."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Conf:
    # Limits and weights the results depend on.
    fit_error_max: float = 3.5
    length_gap_max: float = 0.08
    segments: int = 26
    keep_within_best: float = 6.0
    color_window: float = 7.0
    color_discount: float = 0.3
    y_shift_max: float = 5.0
    hash_distance: int = 15
    same_shape_max: float = 2.2
    duplicate_distance: float = 22.0
    near_miss_distance: float = 66.0
    side_angle_max: float = math.radians(12)
    strict_rmse: float = 0.025
    strict_ratio: float = 0.85
    relaxed_rmse: float = 0.08
    relaxed_ratio: float = 0.65
    ncc_min: float = 0.70
    profile_points: int = 50
    edge_spread: float = 1.8
    border_steps_max: int = 1000  # this and the next are not read: the board search has no limit of steps; kept so that saved settings load
    steps_max: int = 150_000_000
    partial_steps_max: int = 5_000_000
    known_error: float = 3.5
    color_min: float = 0.3
    gap_x: float = 5.699827119
    gap_y: float = 9.121796862
    grid_width: int = 40
    grid_height: int = 25
    photo_scale: float = 10.0
    block_size: int = 51
    blur_size: int = 5
    morph_size: int = 5
    threshold_c: int = 10
    min_area_ratio: float = 0.005

    def with_file(self, path: str) -> Conf:
        """Overrides from a JSON object; unknown keys are an error."""
        with open(path) as f:
            return self.with_values(json.load(f))

    def with_values(self, values: dict) -> Conf:
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=1)

    def errors(self) -> list[str]:
        """What is wrong with the settings; empty if nothing."""
        out = []
        for name in ("block_size", "blur_size", "morph_size"):
            v = getattr(self, name)
            if v < 3 or v % 2 == 0:
                out.append(f"{name} must be odd and at least 3, not {v}")
        for name in ("fit_error_max", "keep_within_best", "segments", "profile_points", "grid_width", "grid_height", "min_area_ratio"):
            if getattr(self, name) <= 0:
                out.append(f"{name} must be positive")
        for name in ("length_gap_max", "color_discount", "ncc_min", "strict_ratio", "relaxed_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                out.append(f"{name} must lie between 0 and 1")
        if self.relaxed_rmse < self.strict_rmse:
            out.append("relaxed_rmse must not be below strict_rmse")
        return out

    def tuned(self, width: int, height: int, brightness: float | None = None, contrast: float | None = None) -> Conf:
        """Settings for one image size and light; never changes what it starts from, so calls don't add up."""
        odd = lambda v, lo, hi: (w := int(max(lo, min(hi, v)))) + (w % 2 == 0)
        k = max(width, height) / 2000
        c = self.threshold_c
        if brightness is not None:
            c += 3 if brightness > 200 else -3 if brightness < 80 else 0
        if contrast is not None:
            c += -2 if contrast < 30 else 0
        return replace(self, block_size=odd(self.block_size * k, 11, 151), blur_size=odd(self.blur_size * k, 3, 15), morph_size=odd(self.morph_size * k, 3, 15), threshold_c=c)
