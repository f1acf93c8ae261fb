"""Levels, chains, outlines, landmarks and contributions on drawn images with known answers."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from osseo.operators import artifacts as A, chain as C, contributions as X, hips as H, landmarks as L, levels as V, neighbourhood as N

PIXELS = "frame_id long, y int, x int, z double, m boolean"


def pixels(spark, *frames):
    """A pixel relation of (z, m) images."""
    parts = []
    for k, (z, m) in enumerate(frames):
        y, x = np.indices(z.shape)
        parts.append(pd.DataFrame({"frame_id": k, "y": y.ravel(), "x": x.ravel(), "z": z.ravel().astype(float), "m": np.asarray(m, bool).ravel()}))
    return spark.createDataFrame(pd.concat(parts), PIXELS)


def spine(crest: int | None = 70, h: int = 100, w: int = 80):
    """A column, and wings of the pelvis from a row on."""
    m = np.zeros((h, w), bool)
    m[5:95, 35:45] = True
    if crest is not None:
        m[crest:95, 5:20] = m[crest:95, 60:75] = True
    return m.astype(float), m


def discs(spark, *per_frame):
    return spark.createDataFrame([(k, int(y)) for k, ys in enumerate(per_frame) for y in ys], "frame_id long, y int")


def column(masked):
    return H.row_filled(N.largest(masked))


def test_levels_count_from_the_crest(spark):
    masked = pixels(spark, spine(), spine(None), spine(), spine(98), spine())
    found = discs(spark, [14, 28, 42, 56, 71, 84, 90], [20, 40], [8, 16, 24, 32, 40, 48, 56, 64, 71, 78, 86, 94], [20, 40, 60, 80], [30])
    got = {r.frame_id: r for r in V.spine_levels(masked, column(masked), found).collect()}
    r = got[0]
    # 71 is L4/L5, so 14 is Th12/L1, and there is less than a body above it
    assert (r.no_levels, r.crest_rel, r.levels_dropped, r.top_vertebra, r.l1_visible, r.crest_in_frame, r.levels_below_crest) == (0, 0.7, 0, 0, 0, 1, 2)
    assert got[1].no_levels == 1 and got[1].crest_rel is None and got[4].no_levels == 1 and got[3].no_levels == 1
    r = got[2]
    # four above, two below
    assert (r.levels_dropped, r.top_vertebra, r.levels_below_crest) == (12 - 7, 0, 2) and r.l1_visible == 1


def test_dim_wings_need_the_soft_mask(spark):
    z, m = spine()
    dim = m.copy()
    dim[:, :20] = dim[:, 60:] = False
    z = np.where(m & ~dim, 0.4, z)
    z[0, :30], z[0, 30:60] = 0.0, 0.4
    masked = pixels(spark, (z, dim))
    asked = []

    def soft(frames):
        asked.append(frames.count())
        thresholds = frames.select("frame_id", F.lit(60).alias("t1"))
        return N.soft_bone(masked, thresholds)

    got = V.spine_levels(masked, column(masked), discs(spark, [30, 50, 71]), soft).first()
    assert asked == [1] and (got.no_levels, got.crest_rel, got.top_vertebra) == (0, 0.7, 2)
    assert V.spine_levels(masked, column(masked), discs(spark, [30, 50, 71])).first().no_levels == 1


def test_soft_bone_drops_crumbs(spark):
    z = np.zeros((30, 30))
    z[5:20, 5:20], z[25, 25] = 0.5, 0.5
    got = N.soft_bone(pixels(spark, (z, z > 0)), spark.createDataFrame([(0, 100)], "frame_id long, t1 int"))
    assert got.where("m").agg(F.count("*").alias("n"), F.max("x").alias("x")).first()[:] == (15 * 15 - 4 * 2, 19)  # two pixels of each corner


def test_closing_is_horizontal(spark):
    def closed(dy: int, dx: int):
        z = np.zeros((60, 80))
        z[20 : 20 + 6, 20 : 20 + 6] = z[20 + dy : 26 + dy, 20 + dx : 26 + dx] = 1.0
        mask = N.bone_mask(pixels(spark, (z, z > 0)), spark.createDataFrame([(0, 128)], "frame_id long, t2 int"))
        return mask.where(f"m AND y = {22 + dy // 2} AND x = {22 + dx // 2}").count() == 1

    assert closed(0, 6 + 15) and not closed(6 + 15, 0)


def test_elements():
    assert sorted(N.ellipse(3)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    size = {n: len(N.ellipse(n)) for n in (5, 7, 9, 11, 14, 15)}
    # the published masks of these sizes, row by row
    assert size[5] == 1 + 5 + 5 + 5 + 1 and size[7] == 1 + 5 + 7 + 7 + 7 + 5 + 1 and size[9] == 1 + 7 + 7 + 9 + 9 + 9 + 7 + 7 + 1
    assert {dy for dy, _ in N.ellipse(14)} == {*range(-7, 7)} and {dx for _, dx in N.ellipse(14)} == {*range(-7, 7)}


def traced(mask: np.ndarray) -> tuple[float, float]:
    """Area and length of the outline of the one component, by walking from border pixel to border pixel."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    wide = np.pad(mask, 1)
    y, x = (int(v[0]) for v in np.nonzero(wide))
    at, back, walk = (y, x), 4, [(y, x)]
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + ring[d][0], at[1] + ring[d][1])
            if wide[to]:
                break
        else:
            return 0.0, 0.0
        if (at, d) == first:
            break
        first = first or (at, d)
        at, back = to, (d + 4) % 8
        walk.append(at)
    walk = walk[:-1] if walk[0] == walk[-1] else walk
    ends = [*zip(walk, walk[1:] + walk[:1])]
    return abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in ends)) / 2, sum(math.dist(a, b) for a, b in ends)


def test_outlines():
    square, ring, diagonal = np.zeros((9, 9), bool), np.zeros((11, 11), bool), np.eye(7, dtype=bool)
    square[2:7, 2:7] = True
    ring[1:10, 1:10] = True
    ring[3:8, 3:8] = False
    ring[5, 5] = True  # an island in the hole is no outer outline
    for mask, area, length in ((square, 16, 16), (ring, 64, 32), (diagonal, 0, 12 * math.sqrt(2)), (np.ones((1, 1), bool), 0, 0), (np.ones((1, 6), bool), 0, 10)):
        _, a, p = N.outlines(mask)
        assert len(a) == 1 and (a[0], p[0]) == pytest.approx((area, length))
    r = np.random.default_rng(4)
    for _ in range(60):
        mask = r.random((9, 9)) < 0.6
        parts, area, length = N.outlines(mask)
        for k in range(len(area)):
            assert (area[k], length[k]) == pytest.approx(traced(parts == k + 1))
    assert len(N.outlines(np.zeros((4, 4), bool))[1]) == 0


def test_contours_of_frames(spark):
    ring = np.zeros((11, 11))
    ring[1:10, 1:10], ring[3:8, 3:8], ring[5, 5] = 1, 0, 1
    masked = pixels(spark, (ring, ring > 0), (ring * 0, ring > 2))
    assert {r.frame_id: r.n_components for r in N.contour_count(masked).collect()} == {0: 1, 1: 0}
    assert N.contours(masked).first()[:] == (0, 1, 81, 64.0, 32.0)


def test_step_distance():
    m = np.zeros((40, 50), bool)
    m[3:30, 5:45] = True
    bg = np.argwhere(~m)
    for y, x in ((3, 5), (16, 25), (10, 40), (29, 44)):
        dy, dx = np.abs(bg - (y, x)).T
        far, near = np.maximum(dy, dx), np.minimum(dy, dx)
        lengths = np.where(far >= 2 * near, 2.1969 * near + far - 2 * near, 2.1969 * (far - near) + 1.4 * (2 * near - far))
        assert N.step_distance(m)[y, x] == pytest.approx(lengths.min())
    assert np.isinf(N.step_distance(np.ones((3, 3), bool))).all()


def femur(neck: int = 10):
    """A head of radius 14, a neck that leans to it, a trochanter to the left and a shaft of width 20."""
    m = np.zeros((140, 120), bool)
    y, x = np.indices(m.shape)
    m[62:140, 45:70] = True
    m |= (y - 30) ** 2 + (x - 64) ** 2 <= 14**2
    m |= (y >= 30) & (y <= 62) & (np.abs(x - (64 - (y - 30) * 7 / 96)) <= neck / 2)
    m[56:70, 38:56] = True
    return m.astype(float), m


def test_landmarks_of_a_drawn_femur(spark):
    bone = pixels(spark, femur(), femur(6), (np.zeros((30, 30)), np.zeros((30, 30), bool)))
    points = {r.frame_id: r for r in L.landmark_points(bone).collect()}
    p = points[0]
    assert abs(p.hx - 64) <= 1 and abs(p.hy - 30) <= 1 and abs(p.hr - 14) < 1.2 and abs(p.sd * 2 - 13) < 2
    assert 40 < p.ny < 62 and abs(p.nr - 5) < 1.5
    got = {r.frame_id: r for r in L.femur_points(bone).collect()}
    assert got[2].empty_lm == 1 and got[2].prox_r_px is None
    assert got[0].empty_lm == 0 and 0.2 < got[1].isthmus_ratio < got[0].isthmus_ratio < 0.5
    # the neck goes up and a little to the right of the shaft, which points down
    assert 160 < got[0].prox_axis_deg < 180 and got[0].gt_offset_ratio == pytest.approx((p.sx - 38) / (2 * p.hr), abs=0.05) and got[0].prox_r_px == p.hr


def test_wings_along_the_chain(spark):
    def frame(wing: int, wire: bool, glare: bool = False):
        z = np.full((120, 100), 0.1)
        z[:, 44:57] = 0.8
        if wing:
            z[120 - wing :, 5:30] = 0.6
        if wire:
            z[30:32, 10:30] = 0.9
        if glare:
            z[10:, 80:98] = 0.7
        return z, z > 0.5

    masked = pixels(spark, frame(30, False), frame(0, True), frame(40, True, True), frame(20, False))
    points = spark.createDataFrame([(k, 20 + 20 * i, 50) for k in range(3) for i in range(5)], "frame_id long, y int, px int")
    got = {r.frame_id: r for r in C.chain_features(masked, points, half_width=8.0).collect()}
    assert 30 / 20 - 0.1 <= got[0].kp_wing_vis <= 30 / 20 + 0.1 and got[0].kp_wing_absent == 0 and got[0].kp_art_frac == 0
    assert got[1].kp_wing_vis == 0 and got[1].kp_wing_absent == 1 and got[1].kp_art_frac == pytest.approx(40 / 12_000)
    assert got[2].kp_wing_vis == 1 and got[2].kp_art_frac >= 40 / 12_000  # glare counts as a pelvis that is seen, and hides nothing
    assert got[3][1:] == (1.0, 0.0, 0.0)  # no chain
    placed = C.along_chain(masked, points).where("frame_id = 0 AND x = 60 AND y IN (20, 30, 110)").orderBy("y").collect()
    assert [(r.across, r.along, r.pitch) for r in placed] == [(10, 0, 20), (10, 0.5, 20), (10, 4.5, 20)] and placed[0].ref == pytest.approx(0.8)


def test_arcs(spark):
    z = np.full((80, 80), 0.2)
    z[10, 20:60] = z[50, 20:30] = 0.9
    m = np.zeros((80, 80), bool)
    m[60:, :] = True
    got = A.arcs(pixels(spark, (z, m))).first()
    long, short = (4 * math.sqrt(np.var(np.arange(n), ddof=1)) / 80 for n in (40, 10))
    assert got[1:] == pytest.approx((long, long + short, 1, 40 / (28 * 80)))


def exhaustive(x, y, area, score, pitch, w):
    n, best = len(y), (-math.inf, None)
    for size in range(2, n + 1):
        for path in itertools.combinations(range(n), size):
            steps = [(x[b] - x[a], y[b] - y[a]) for a, b in zip(path, path[1:])]
            if any(dy <= C.LEAST_STEP * pitch for _, dy in steps):
                continue
            node = sum(w["score"] * score[i] - w["size"] * abs(math.log(area[i] / (0.9 * 1.4 * pitch * pitch))) + w["number"] for i in path)
            lengths = [math.hypot(*s) for s in steps]
            turn = sum(math.acos(max(-1, min(1, (a[0] * b[0] + a[1] * b[1]) / (p * q)))) for a, b, p, q in zip(steps, steps[1:], lengths, lengths[1:]))
            change = sum(abs(q - p) / p for p, q in zip(lengths, lengths[1:]))
            total = node - w["step"] * sum(abs(v - pitch) / pitch for v in lengths) - w["turn"] * turn - w["change"] * change
            best = max(best, (total, [*path]))
    return best[1]


def test_chain_equals_exhaustive_search():
    r = np.random.default_rng(8)
    for k in range(12):
        y, x = np.sort(r.uniform(0, 200, 12)), r.uniform(30, 60, 12)
        area, score = r.uniform(300, 900, 12), r.normal(0, 2, 12)
        w = C.WEIGHTS | {"change": float(k % 3)}
        assert C.best_path(x, y, area, score, 25.0, w) == exhaustive(x, y, area, score, 25.0, w)
    assert C.best_path(np.array([1.0, 2]), np.array([0.0, 1]), np.ones(2), np.array([1.0, 5]), 25.0) == [1]


def test_bodies_take_the_most_confident(spark):
    rows = [(0, 50.0, 20.0 * i, 18.0, 28.0, 1.0, 0.9) for i in range(6)] + [(0, 90.0, 30.0, 18.0, 28.0, 1.0, 0.5), (0, 50.0, 50.0, 18.0, 28.0, 9.0, 0.01)]
    df = spark.createDataFrame(rows, "frame_id long, x double, y double, w double, h double, logit double, conf double")
    assert [r.y for r in C.bodies(df, 20.0).orderBy("ord").collect()] == [0, 20, 40, 60, 80, 100]
    assert C.bodies(df, 20.0, taken=3).count() == 3


def plain_shapley(row, trees, weights):
    """Over all orders of the features, by the expected value of each tree."""
    from math import factorial

    def value(nodes, known, at=0):
        p, n, left, right, f, t = nodes[at]
        if left < 0:
            return p
        if f in known:
            return value(nodes, known, left if row[f] <= t else right)
        return (nodes[left][1] * value(nodes, known, left) + nodes[right][1] * value(nodes, known, right)) / n

    m, out = len(row), [0.0] * len(row)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for size in range(m):
            for known in itertools.combinations(others, size):
                share = factorial(size) * factorial(m - 1 - size) / factorial(m)
                out[i] += share * sum(w * (value(t, {*known, i}) - value(t, {*known})) for t, w in zip(trees, weights))
    return out


def test_shapley_of_small_trees():
    trees = [
        {0: (0.0, 10, 1, 2, 0, 0.5), 1: (0.0, 6, 3, 4, 1, 0.2), 2: (3.0, 4, -1, -1, -1, 0), 3: (1.0, 2, -1, -1, -1, 0), 4: (0.0, 4, 5, 6, 0, 0.1), 5: (-2.0, 1, -1, -1, -1, 0), 6: (0.5, 3, -1, -1, -1, 0)},
        {0: (0.0, 10, 1, 2, 2, 0.0), 1: (1.0, 5, -1, -1, -1, 0), 2: (-1.0, 5, -1, -1, -1, 0)},
    ]
    model = [leaf for t, w in zip(trees, (1.0, 0.3)) for leaf in X.leaves(t, w)]
    x = np.random.default_rng(1).uniform(-1, 1, (20, 4))
    assert np.allclose(X.shapley(x, model), [plain_shapley(row, trees, (1.0, 0.3)) for row in x])


def test_contributions_add_up_to_the_margin(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = spark.range(400).select("id", F.array(*((F.abs(F.xxhash64("id", F.lit(k))) % 1000 / 1000.0) for k in range(5))).alias("f"))
    rows = rows.withColumn("y", (F.col("f")[0] + F.col("f")[1] * F.col("f")[2] > 0.8).cast("double")).withColumn("v", array_to_vector("f"))
    model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=12, maxDepth=3, seed=5).fit(rows)
    margins = {r.id: r.m for r in model.transform(rows).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    got = X.tree_contributions(rows, model, "id", "f", [f"f{k}" for k in range(5)], top=6).collect()
    assert len(got) == 400
    for r in got:
        assert r.margin == pytest.approx(margins[r.id]) and r.base + sum(c.impact for c in r.contributions) == pytest.approx(r.margin)
        assert [abs(c.impact) for c in r.contributions] == sorted((abs(c.impact) for c in r.contributions), reverse=True)
