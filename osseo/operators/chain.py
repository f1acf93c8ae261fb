"""Measurements along the chain of vertebral bodies: a coordinate frame that follows it, the pelvis beside it, thin bright things, and the chain itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from osseo.operators.neighbourhood import FRAME, _image, dilated, ellipse, eroded, label
from osseo.operators.pixels import chain_positions

# Half a body's width in pixels, the corridor in such halves, brightness of a wing against that of bodies, the share of
# a half that a wing's rows have, the rows at the border that it must reach, the share of the frame that it cannot exceed; size and
# threshold of the top-hat, the brightest value against bodies, darkness that is no tissue, and half the window around a body's centre.
HALF_WIDTH, CORRIDOR, WING, WING_ROW, WING_BORDER, WING_MOST = 35.0, 1.3, 0.35, 0.3, 3, 0.6
HAT, HAT_LEAST, BRIGHTEST, DARK, WINDOW = 7, 0.25, 3.0, 0.02, 3
MARGIN = 2


def body_level(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """frame_id, ref: the median brightness of the windows around the points (frame_id, y, px), 7 rows by 13 columns; a pixel counts once a window."""
    offsets = lambda r: F.sequence(F.lit(-r), F.lit(r))
    around = points.select(FRAME, F.bround("y").cast("int").alias("_y"), F.bround("px").cast("int").alias("_x")).withColumn("dy", F.explode(offsets(WINDOW))).withColumn("dx", F.explode(offsets(2 * WINDOW)))
    around = around.select(FRAME, (F.col("_y") + F.col("dy")).alias("y"), (F.col("_x") + F.col("dx")).alias("x"))
    return pixels.select(FRAME, "y", "x", "z").join(around, [FRAME, "y", "x"]).groupBy(FRAME).agg(F.median("z").alias("ref"))


def along_chain(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Pixels (frame_id, y, x, z) in the frame of the chain of ``points`` (frame_id, y, px; two at least).

    across: pixels right of the polyline through the points, whose end segments go on; along: place in bodies, 0 at the first point;
    pitch: the median step of the points; ref: the brightness of bodies. Frames with fewer points are left out.
    """
    w = Window.partitionBy(FRAME).orderBy("y")
    rows = pixels.select(FRAME, "y").distinct()
    ordered = points.select(FRAME, F.col("y").cast("double").alias("y"), F.col("px").cast("double").alias("px")).withColumn("i", F.row_number().over(w) - 1)
    steps = ordered.withColumn("step", F.col("y") - F.lag("y").over(w)).groupBy(FRAME).agg(F.median("step").alias("pitch"), F.count("*").alias("n")).where("n >= 2")
    axis = chain_positions(ordered, rows).withColumnRenamed("x", "_axis")
    place = chain_positions(ordered.select(FRAME, "y", F.col("i").cast("double").alias("px")), rows).withColumnRenamed("x", "along")
    facts = steps.select(FRAME, "pitch").join(body_level(pixels, points), FRAME)
    by_row = axis.join(place, [FRAME, "y"]).join(facts, FRAME)
    return pixels.select(FRAME, "y", "x", "z").join(by_row, [FRAME, "y"]).select(FRAME, "y", "x", "z", (F.col("x") - F.col("_axis")).alias("across"), "along", "pitch", "ref")


def blurred(z: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian means to four deviations; beyond a border the image is mirrored, the border pixel included."""
    r = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        wide = np.pad(z, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        z = sum(k * np.take(wide, range(i, i + z.shape[axis]), axis) for i, k in enumerate(weights))
    return z


def wing_rows(z: np.ndarray, across: np.ndarray, ref: float, half_width: float) -> float:
    """How high the pelvis reaches from the lower border: the greater of both sides' bright parts that touch it."""
    bright, h, most = blurred(z) >= WING * ref, len(z), 0
    for side in (across <= -CORRIDOR * half_width, across >= CORRIDOR * half_width):
        parts = label(bright & side, eight=False)
        touching = np.unique(parts[h - WING_BORDER :])
        rows = np.flatnonzero(np.isin(parts, touching[touching > 0]).sum(1) >= WING_ROW * half_width)
        most = max(most, h - rows[0] if len(rows) else 0)
    return float(most)


def thin_things(z: np.ndarray, across: np.ndarray, ref: float, stop: float | None, half_width: float) -> np.ndarray:
    """Bright and thin pixels outside the corridor, above the row ``stop`` and away from blacked-out places."""
    light = np.clip(z / max(ref, 1e-3), 0, BRIGHTEST).astype(np.float32)
    square = [(dy, dx) for dy in range(-MARGIN, MARGIN + 1) for dx in range(-MARGIN, MARGIN + 1)]
    tissue = eroded(np.pad(z > DARK, MARGIN), square)[MARGIN:-MARGIN, MARGIN:-MARGIN]
    zone = (np.abs(across) >= CORRIDOR * half_width) & tissue
    if stop is not None:
        zone[int(stop) :] = False
    return (light - dilated(eroded(light, ellipse(HAT)), ellipse(HAT)) >= HAT_LEAST) & zone


def chain_features(pixels: DataFrame, points: DataFrame, half_width: float = HALF_WIDTH) -> DataFrame:
    """kp_wing_vis (height of the pelvis in bodies), kp_wing_absent and kp_art_frac (thin bright share of the frame) of each frame.

    Without two points nothing is held against a frame: 1, 0 and 0. What reaches higher than WING_MOST of the frame is glare, not a pelvis:
    it counts as seen, and hides nothing.
    """
    names = ("kp_wing_vis", "kp_wing_absent", "kp_art_frac")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, across = _image(pdf, "z", float), _image(pdf, "across", float)
        ref, h = float(pdf.ref.iloc[0]), len(z)
        high = wing_rows(z, across, ref, half_width)
        pelvis = 0 < high < WING_MOST * h
        seen = high / float(pdf.pitch.iloc[0]) if pelvis else float(high > 0)
        thin = thin_things(z, across, ref, h - high if pelvis else None, half_width)
        return pd.DataFrame({FRAME: [pdf[FRAME].iloc[0]], "kp_wing_vis": [seen], "kp_wing_absent": [float(seen <= 0)], "kp_art_frac": [thin.sum() / z.size]})

    got = along_chain(pixels, points).groupBy(FRAME).applyInPandas(one, f"{FRAME} long, " + ", ".join(f"{n} double" for n in names))
    frames = pixels.select(FRAME).distinct()
    return frames.join(got, FRAME, "left").select(FRAME, *(F.coalesce(n, F.lit(v)).alias(n) for n, v in zip(names, (1.0, 0.0, 0.0), strict=True)))


# The least confidence of a candidate, how many take part, the least step in pitches, a body's size in pitches, the
# pitch in pixels, and the fitted weights of a body's score, size, number, step, turn and change of step.
POOL, TAKEN, LEAST_STEP, BODY, PITCH = 0.05, 30, 0.55, (0.9, 1.4), 52.0
WEIGHTS = {"score": 1.2418418802382916, "size": 0.17134103222406044, "number": 3.546852470389268, "step": 2.547764021483717, "turn": 2.2863905908415556, "change": 0.0}


def best_path(x: np.ndarray, y: np.ndarray, area: np.ndarray, score: np.ndarray, pitch: float, weights: dict[str, float] = WEIGHTS) -> list[int]:
    """Places of the best chain of candidates in order of y, by the sum of its nodes, steps, and turns and changes of neighbouring steps.

    A state is the last step (i, j), so that a further node pays for the angle and the change between both steps: n squared states
    and n choices each. Steps go down by LEAST_STEP pitches at least. Without any step, the candidate of the best score.
    """
    n = len(y)
    if n < 2:
        return [*range(n)]
    dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
    length = np.hypot(dx, dy)
    allowed = dy > LEAST_STEP * pitch
    if not allowed.any():
        return [int(score.argmax())]
    node = weights["score"] * score - weights["size"] * np.abs(np.log(np.maximum(area, 1e-6) / (BODY[0] * BODY[1] * pitch * pitch))) + weights["number"]
    step = -weights["step"] * np.abs(length - pitch) / pitch
    best = np.where(allowed, node[:, None] + node[None, :] + step, -np.inf)
    came = np.full((n, n), -1)
    safe = np.maximum(length, 1e-6)
    for k in range(n):
        for j in np.flatnonzero(allowed[:, k]):
            before = np.flatnonzero(allowed[:, j])
            if not len(before):
                continue
            cosine = np.clip((dx[before, j] * dx[j, k] + dy[before, j] * dy[j, k]) / (safe[before, j] * safe[j, k]), -1, 1)
            paid = weights["turn"] * np.arccos(cosine) + weights["change"] * np.abs(length[j, k] - length[before, j]) / safe[before, j]
            total = best[before, j] + node[k] + step[j, k] - paid
            at = int(total.argmax())
            if total[at] > best[j, k]:
                best[j, k], came[j, k] = total[at], before[at]
    i, j = np.unravel_index(int(best.argmax()), best.shape)
    out = [int(j), int(i)]
    while came[i, j] >= 0:
        i, j = came[i, j], i
        out.append(int(i))
    return out[::-1]


def bodies(candidates: DataFrame, pitch: float = PITCH, weights: dict[str, float] = WEIGHTS, taken: int = TAKEN) -> DataFrame:
    """frame_id, ord, y, px of the best chain through a frame's candidates (frame_id, x, y, w, h, logit, conf): the ``taken`` most confident take part."""
    order = Window.partitionBy(FRAME).orderBy(F.col("conf").desc(), "y", "x")
    pool = candidates.where(F.col("conf") >= POOL).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= taken)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        x, y, w, h, score = (pdf[c].to_numpy(float) for c in ("x", "y", "w", "h", "logit"))
        at = best_path(x, y, w * h, score, pitch, weights)
        return pd.DataFrame({FRAME: pdf[FRAME].iloc[0], "ord": np.arange(len(at)), "y": y[at], "px": x[at]})

    return pool.groupBy(FRAME).applyInPandas(one, f"{FRAME} long, ord int, y double, px double")
