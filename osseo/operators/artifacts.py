"""Bright structures inside and outside the bone, and the parts of a mask that belong together; one frame a group, in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from osseo.operators.neighbourhood import FRAME, _image, dilated, ellipse, eroded, label, outlines

# Sizes of the elements, thresholds of the top-hat and of saturation, least areas.
INSIDE, INSIDE_LEAST, INSIDE_AREA, SATURATED = 11, 12, 4, 0.995
OUTSIDE, OUTSIDE_LEAST, OUTSIDE_AREA, ELONGATED, UPPER = 15, 25, 8, 6, 0.45
ISLAND_SHARE, ISLAND_GAP, CORE_SHARE = 0.08, 14, 0.25


def bright_hat(z: np.ndarray, size: int) -> np.ndarray:
    """The image in 256 steps less its opening with an elliptic element."""
    steps = np.floor(np.clip(z, 0, 1) * 255)
    return steps - dilated(eroded(steps, ellipse(size)), ellipse(size))


def inside(masked: DataFrame) -> DataFrame:
    """Bright inclusions of the mask: in_empty, and their share, the largest one's, their number, saturation and contrast.

    The threshold is the 99th percentile of the top-hat inside the mask, 12 steps of 255 at least. A frame without mask pixels
    has in_empty 1 and nulls.
    """
    names = ("in_empty", "in_hot_frac", "in_hot_max_frac", "in_hot_n", "in_sat_frac", "in_contrast")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, z = _image(pdf, "m", bool), _image(pdf, "z", float)
        values: list[float | None] = [1.0, None, None, None, None, None]
        if m.any():
            hat = bright_hat(z, INSIDE)
            hot = m & (hat >= max(INSIDE_LEAST, np.floor(np.percentile(hat[m], 99))))
            areas = np.bincount(label(hot).ravel())[1:]
            areas, area = areas[areas >= INSIDE_AREA], m.sum()
            values = [0.0, hot.sum() / area, areas.max(initial=0) / area, float(len(areas)), (z[m] >= SATURATED).mean(), np.percentile(z[m], 99) - np.median(z[m])]
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]]} | {k: np.array([v], float) for k, v in zip(names, values, strict=True)})

    return masked.select(FRAME, "y", "x", "z", "m").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, " + ", ".join(f"{n} double" for n in names))


def outside(masked: DataFrame) -> DataFrame:
    """Thin bright structures away from the mask: their number, greatest elongation and area share, and brightness of all and of the upper part.

    A structure's area and outline are those of the polygon through its border pixels; elongation is outline squared over 4 pi
    times the area.
    """
    names = ("thin_n", "thin_elong", "thin_area_frac", "outside_bright", "outside_bright_upper", "thin_upper_frac")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, z = _image(pdf, "m", bool), _image(pdf, "z", float)
        hat = bright_hat(z, OUTSIDE)
        hat[dilated(m, [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4)])] = 0
        _, area, edge = outlines(hat >= OUTSIDE_LEAST)
        edge, area = edge[area >= OUTSIDE_AREA], area[area >= OUTSIDE_AREA]
        long = edge**2 / (4 * np.pi * area + 1e-9)
        long = long[long > ELONGATED]
        upper = hat[: int(UPPER * len(hat))]
        values = [len(long), long.max(initial=0), area.sum() / hat.size, hat.mean() / 255, upper.mean() / 255, (upper >= OUTSIDE_LEAST).mean()]
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]]} | {k: np.array([v], float) for k, v in zip(names, values, strict=True)})

    return masked.select(FRAME, "y", "x", "z", "m").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, " + ", ".join(f"{n} double" for n in names))


# Size of the element of arcs, their least threshold, percentile and area, the share of the width from which one is long, the upper part.
ARC, ARC_LEAST, ARC_RANK, ARC_AREA, ARC_LONG, ARC_UPPER = 11, 18, 99.0, 6, 0.25, 0.35


def arcs(masked: DataFrame) -> DataFrame:
    """Long thin bright arcs outside the mask: the longest, all lengths, the number of long ones (in widths of the frame), and their share of the upper part.

    A length is four deviations along the main axis of a part of ARC_AREA pixels at least.
    """
    names = ("arc_max_len", "arc_total_len", "arc_n_long", "arc_upper_frac")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, z = _image(pdf, "m", bool), _image(pdf, "z", float)
        hat = bright_hat(z, ARC)
        out = (hat >= max(ARC_LEAST, int(np.percentile(hat, ARC_RANK)))) & ~m
        parts = label(out)
        y, x = np.nonzero(parts)
        of, n = parts[y, x], np.bincount(parts.ravel())[1:]
        mean = lambda v: np.bincount(of, v, len(n) + 1)[1:] / n
        cy, cx = mean(y), mean(x)
        vy, vx, c = (mean(a) * n / np.maximum(n - 1, 1) for a in ((y - cy[of - 1]) ** 2, (x - cx[of - 1]) ** 2, (y - cy[of - 1]) * (x - cx[of - 1])))
        most = (vy + vx) / 2 + np.hypot((vy - vx) / 2, c)
        length = (4 * np.sqrt(np.maximum(most, 0)) / m.shape[1])[n >= ARC_AREA]
        values = [length.max(initial=0), length.sum(), float((length > ARC_LONG).sum()), out[: int(ARC_UPPER * len(out))].mean()]
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]]} | {k: np.array([v], float) for k, v in zip(names, values, strict=True)})

    return masked.select(FRAME, "y", "x", "z", "m").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, " + ", ".join(f"{n} double" for n in names))


def main_body(masked: DataFrame) -> DataFrame:
    """The mask without islands: parts below 8 % of the largest one's area, or farther from it than an ellipse of 14 reaches."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = label(_image(pdf, "m", bool))
        area = np.bincount(parts.ravel())
        area[0] = 0
        main = area.argmax()
        near = np.unique(parts[dilated(parts == main, ellipse(ISLAND_GAP))])
        keep = [k for k in near.tolist() if k and area[k] >= ISLAND_SHARE * area[main]]
        return pdf.assign(m=np.isin(parts, keep)[pdf.y, pdf.x])

    return masked.select(FRAME, "y", "x", "z", "m").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, y int, x int, z double, m boolean")


def cores(levels: DataFrame) -> DataFrame:
    """Pixels (frame_id, y, x, level; 0: none) with each level reduced to its parts of 25 % of its largest part's area at least."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = _image(pdf, "level", int)
        out = np.zeros_like(grid)
        for level in np.unique(grid[grid > 0]):
            parts = label(grid == level)
            area = np.bincount(parts.ravel())
            area[0] = 0
            out[np.isin(parts, np.flatnonzero(area >= CORE_SHARE * area.max())) & (parts > 0)] = level
        return pdf.assign(level=out[pdf.y, pdf.x])

    return levels.select(FRAME, "y", "x", "level").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, y int, x int, level int")
