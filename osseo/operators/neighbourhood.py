"""Two-dimensional neighbourhoods and ordered recurrences, one frame per group (bounded by the image size), in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

FRAME = "frame_id"


def _image(pdf: pd.DataFrame, value: str, kind) -> np.ndarray:
    out = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), kind)
    out[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[value].to_numpy()
    return out


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers from 1 (in scan order), 0 for background, by repeated spread of the smallest number."""
    h, w = mask.shape
    ids = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        before = ids.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
            low = np.minimum(ids[a], ids[b])
            both = mask[a] & mask[b]
            for part in (a, b):
                view = ids[part]
                view[both] = np.minimum(view[both], low[both])
        if (before == ids).all():
            break
    return np.searchsorted(np.unique(ids[mask]), ids) * mask + mask


def components(masked: DataFrame, eight: bool = True) -> DataFrame:
    """frame_id, y, x, component of each mask pixel."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = label(_image(pdf, "m", bool), eight)
        y, x = np.nonzero(got)
        return pd.DataFrame({FRAME: pdf[FRAME].iloc[0], "y": y, "x": x, "component": got[y, x]})

    return masked.select(FRAME, "y", "x", "m").groupBy(FRAME).applyInPandas(one, "frame_id long, y int, x int, component int")


def largest(masked: DataFrame) -> DataFrame:
    """The pixels with the mask reduced to its largest component (the first in scan order among equals)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = label(_image(pdf, "m", bool))
        sizes = np.bincount(got.ravel())
        sizes[0] = 0
        return pdf.assign(m=(got == sizes.argmax())[pdf.y, pdf.x] & (sizes.max() > 0))

    return masked.select(FRAME, "y", "x", "z", "m").groupBy(FRAME).applyInPandas(one, "frame_id long, y int, x int, z double, m boolean")


def shaft_widths(bone: DataFrame) -> DataFrame:
    """frame_id, shaft_w: twice the median distance to the background in the lowest fifth of the mask, 4 at least."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _image(pdf, "m", bool)
        rows = np.flatnonzero(m.any(1))
        if not len(rows):
            return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]], "shaft_w": [4.0]})
        low = m.copy()
        low[: int(rows[0] + 0.8 * max(1, rows[-1] - rows[0]))] = False
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]], "shaft_w": [max(4.0, 2 * float(np.median(distance(m)[low])))]})

    return bone.select(FRAME, "y", "x", "m").groupBy(FRAME).applyInPandas(one, "frame_id long, shaft_w double")


def shifted(image: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    out = np.full_like(image, fill)
    h, w = image.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = image[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element: in the row dy, as far as sqrt(r * r - dy * dy) rounds to on both sides.

    An element of even size lacks the last row and column: its middle is the place size / 2.
    """
    r = size // 2
    last = size - 1 - r
    return [(dy, dx) for dy in range(-r, last + 1) for half in [round(math.sqrt(r * r - dy * dy))] for dx in range(-half, min(half, last) + 1)]


def dilated(image: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    low = False if image.dtype == bool else -np.inf
    return np.maximum.reduce([shifted(image, dy, dx, low) for dy, dx in element])


def eroded(image: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    high = True if image.dtype == bool else np.inf
    return np.minimum.reduce([shifted(image, dy, dx, high) for dy, dx in element])


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: background that cannot be reached from the border."""
    outside = np.pad(~mask, 1, constant_values=True)
    got = label(outside, eight=False)
    return ~(got == got[0, 0])[1:-1, 1:-1]


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each mask pixel to the background: by columns, then the lower envelope of each row."""
    h, w = mask.shape
    far = h + w
    g = np.where(mask, far, 0).astype(float)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    gap = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.sqrt((g[:, None, :] ** 2 + gap[None]).min(2))


# The lengths of straight, diagonal and knight's steps of the distance.
STRAIGHT, DIAGONAL, KNIGHT = 1.0, 1.4, 2.1969


def step_distance(mask: np.ndarray) -> np.ndarray:
    """Distance of each mask pixel to the background by straight, diagonal and knight's steps; what lies outside the image is no background.

    Without background all distances are infinite.
    """
    d = np.where(mask, np.inf, 0.0)
    steps = [(dy, dx, {1: STRAIGHT, 2: DIAGONAL, 5: KNIGHT}[dy * dy + dx * dx]) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx in (1, 2, 5)]
    while True:
        near = np.minimum.reduce([d] + [shifted(d, dy, dx, np.inf) + cost for dy, dx, cost in steps])
        if (near == d).all():
            return d
        d = near


def distances(masked: DataFrame) -> DataFrame:
    """frame_id, y, x, d: step_distance of each mask pixel, to four decimals."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _image(pdf, "m", bool)
        y, x = np.nonzero(m)
        return pd.DataFrame({FRAME: pdf[FRAME].iloc[0], "y": y, "x": x, "d": np.round(step_distance(m)[y, x], 4)})

    return masked.select(FRAME, "y", "x", "m").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, y int, x int, d double")


def outlines(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label image of the outer components (their holes filled), and for each the area and length of the polygon through its border pixels.

    The walk round a component can be summed over squares of four neighbouring pixels: a full square adds its area, three of its
    pixels half of it and one diagonal of the walk, two pixels side by side one step, and two across a diagonal that is walked to
    and fro. Components in the holes of others are part of these.
    """
    parts = label(filled(mask))
    wide = np.pad(parts, 1)
    corners = np.stack([wide[:-1, :-1], wide[:-1, 1:], wide[1:, :-1], wide[1:, 1:]])
    owner, held = corners.max(0), (corners > 0).sum(0)  # pixels of a square touch, so they belong to one component
    across = (held == 2) & ((corners[0] > 0) == (corners[3] > 0))
    area = np.select([held == 4, held == 3], [1.0, 0.5], 0.0)
    length = np.select([held == 3, across, held == 2], [math.sqrt(2), 2 * math.sqrt(2), 1.0], 0.0)
    n = int(parts.max(initial=0)) + 1
    return parts, np.bincount(owner.ravel(), area.ravel(), n)[1:], np.bincount(owner.ravel(), length.ravel(), n)[1:]


def contours(masked: DataFrame) -> DataFrame:
    """frame_id, contour (from 1, in scan order), pixels (holes included), area and length of each outer outline of the mask."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, area, length = outlines(_image(pdf, "m", bool))
        return pd.DataFrame({FRAME: pdf[FRAME].iloc[0], "contour": np.arange(1, len(area) + 1), "pixels": np.bincount(parts.ravel(), minlength=len(area) + 1)[1:], "area": area, "length": length})

    return masked.select(FRAME, "y", "x", "m").groupBy(FRAME).applyInPandas(one, f"{FRAME} long, contour int, pixels long, area double, length double")


def contour_count(masked: DataFrame) -> DataFrame:
    """frame_id, n_components: the number of outer outlines, 0 for an empty mask."""
    found = contours(masked).groupBy(FRAME).agg(F.count("*").cast("double").alias("n_components"))
    return masked.select(FRAME).distinct().join(found, FRAME, "left").select(FRAME, F.coalesce("n_components", F.lit(0.0)).alias("n_components"))


def bone_mask(normal: DataFrame, thresholds: DataFrame) -> DataFrame:
    """frame_id, y, x, z, m: the top class after closing, hole filling and opening; thresholds has t2, the last of 256 steps below it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _image(pdf.assign(top=np.floor(pdf.z * 255) > pdf.t2), "top", bool)
        wide = [(dy, dx) for dy in range(-1, 2) for dx in range(-10, 11)]  # the gap between the walls of a shaft is horizontal
        m = eroded(dilated(m, wide), wide)
        m = filled(eroded(dilated(m, ellipse(9)), ellipse(9)))
        m = dilated(eroded(m, ellipse(3)), ellipse(3))
        return pdf[[FRAME, "y", "x", "z"]].assign(m=m[pdf.y, pdf.x])

    return normal.select(FRAME, "y", "x", "z").join(thresholds.select(FRAME, "t2"), FRAME).groupBy(FRAME).applyInPandas(one, "frame_id long, y int, x int, z double, m boolean")


def soft_bone(normal: DataFrame, thresholds: DataFrame) -> DataFrame:
    """frame_id, y, x, z, m: the two upper classes after opening with an ellipse of 5; thresholds has t1."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _image(pdf.assign(some=np.floor(pdf.z * 255) > pdf.t1), "some", bool)
        m = dilated(eroded(m, ellipse(5)), ellipse(5))
        return pdf[[FRAME, "y", "x", "z"]].assign(m=m[pdf.y, pdf.x])

    return normal.select(FRAME, "y", "x", "z").join(thresholds.select(FRAME, "t1"), FRAME).groupBy(FRAME).applyInPandas(one, "frame_id long, y int, x int, z double, m boolean")


def widest(masked: DataFrame) -> DataFrame:
    """frame_id, radius, y, x of the mask pixel farthest from the background (first in scan order)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = distance(np.pad(_image(pdf, "m", bool), 1))[1:-1, 1:-1]
        y, x = np.unravel_index(d.argmax(), d.shape)
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]], "radius": [d[y, x]], "y": [int(y)], "x": [int(x)]})

    return masked.select(FRAME, "y", "x", "m").groupBy(FRAME).applyInPandas(one, "frame_id long, radius double, y int, x int")


def best_chain(y: np.ndarray, r: np.ndarray, step: float) -> list[int]:
    """Positions of the ordered candidates with the best sum of responses, bonus per node and step penalties."""
    scale = float(np.abs(r).max(initial=0))
    score, back = r + 0.45 * scale, np.full(len(r), -1)
    for i in range(len(r)):
        gap = y[i] - y[:i]
        ok = (gap >= 0.55 * step) & (gap <= 1.8 * step)
        if ok.any():
            s = np.where(ok, score[:i] - 0.02 * scale * np.abs(gap - step), -np.inf)
            j = int(s.argmax())
            if s[j] > 0:
                score[i] += s[j]
                back[i] = j
    out, i = [], int(score.argmax()) if len(r) else -1
    while i >= 0:
        out.append(i)
        i = int(back[i])
    return out[::-1]


def chains(candidates: DataFrame, step: float) -> DataFrame:
    """frame_id, ord, y of the best chain through the candidates (frame_id, y, value)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        at = best_chain(pdf.y.to_numpy(float), pdf.value.to_numpy(float), step)
        return pd.DataFrame({FRAME: pdf[FRAME].iloc[0], "ord": np.arange(len(at)), "y": pdf.y.to_numpy()[at]})

    return candidates.groupBy(FRAME).applyInPandas(one, "frame_id long, ord int, y int")


def monotone_levels(scores: np.ndarray) -> np.ndarray:
    """The non-decreasing level of each row with the greatest sum of scores (rows x levels); first wins."""
    n, k = scores.shape
    total, back = scores[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        best = np.maximum.accumulate(total)
        first = np.array([int(np.argmax(total[: c + 1])) for c in range(k)])
        back[i], total = first, best + scores[i]
    out = np.zeros(n, int)
    out[-1] = int(total.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def level_rows(scores: DataFrame, levels: int) -> DataFrame:
    """frame_id, y, level from rows (frame_id, y, s: one score per level)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        return pd.DataFrame({FRAME: pdf[FRAME].iloc[0], "y": pdf.y.to_numpy(), "level": monotone_levels(np.stack(pdf.s.to_numpy())[:, :levels])})

    return scores.groupBy(FRAME).applyInPandas(one, "frame_id long, y int, level int")
