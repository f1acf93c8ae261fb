"""The ridge of the spinous processes: where the brightness across the column peaks, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from osseo.operators.neighbourhood import FRAME, _image

# Least mask pixels and rows of the column, deviations of the blur across and down, the share of rows left out at both
# ends, the least width of a row and of its middle half, and the least number of rows with a peak.
PIXELS, ROWS, ACROSS, DOWN, ENDS, WIDTH, MIDDLE, FOUND = 500, 40, 1.5, 15.0, 0.15, 12, 4, 20
NAMES = ("sp_offset_med", "sp_offset_max", "sp_offset_slope", "sp_offset_sd", "sp_ridge_conf", "sp_width_med")


def blurred(z: np.ndarray, across: float, down: float) -> np.ndarray:
    """Gaussian means to four deviations; the image is mirrored beyond its borders, the border itself not repeated."""
    for axis, sigma in ((0, down), (1, across)):
        r = (round(8 * sigma + 1) | 1) // 2
        weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        n = z.shape[axis]
        at = np.abs((np.arange(-r, n + r) + (n - 1)) % max(2 * (n - 1), 1) - (n - 1))  # a triangle wave: mirrored as often as needed
        wide = np.take(z, at, axis)
        z = sum(k * np.take(wide, range(i, i + n), axis) for i, k in enumerate(weights / weights.sum()))
    return z


def ridge(z: np.ndarray, column: np.ndarray, mask_pixels: int) -> list[float] | None:
    """NAMES of one frame, or None where the column is too small or too few of its rows have a peak."""
    rows = np.flatnonzero(column.any(1))
    if mask_pixels < PIXELS or len(rows) < ROWS:
        return None
    soft, margin, found = blurred(z, ACROSS, DOWN), ENDS * len(rows), []
    for y in range(int(rows[0] + margin), int(rows[-1] - margin) + 1):
        x = np.flatnonzero(column[y])
        if len(x) < WIDTH:
            continue
        across = soft[y, x[0] : x[-1] + 1]
        w = len(across)
        a, b = int(0.25 * w), int(0.75 * w)  # joints and edges at both sides may be brighter
        if b - a < MIDDLE:
            continue
        middle = across[a:b]
        place = a + int(np.argmax(np.round(middle, 12)))
        found.append(((place - (w - 1) / 2) / w, (middle.max() - np.median(across)) / (np.std(across) + 1e-6), w))
    if len(found) < FOUND:
        return None
    off, sure, width = (np.array(v, float) for v in zip(*found))
    height = np.linspace(0, 1, len(off))
    slope = float(((height - height.mean()) * (off - off.mean())).sum() / ((height - height.mean()) ** 2).sum())
    return [float(np.median(np.abs(off))), float(np.percentile(np.abs(off), 90)), slope, float(np.std(off)), float(np.median(sure)), float(np.median(width) / z.shape[1])]


def spinous_ridge(masked: DataFrame, column: DataFrame) -> DataFrame:
    """sp_absent and NAMES (-1 where absent): the ridge's offset from the middle of the column, its slope and spread, and how clear it is.

    ``column`` holds the frames' largest components; ``masked`` the masks that these come from.
    """
    joined = masked.select(FRAME, "y", "x", "z", "m").join(column.select(FRAME, "y", "x", column.m.alias("c")), [FRAME, "y", "x"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = ridge(_image(pdf, "z", float), _image(pdf, "c", bool), int(pdf.m.sum()))
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]], "sp_absent": [float(got is None)]} | {n: [v] for n, v in zip(NAMES, got or [-1.0] * len(NAMES))})

    return joined.groupBy(FRAME).applyInPandas(one, f"{FRAME} long, sp_absent double, " + ", ".join(f"{n} double" for n in NAMES))
