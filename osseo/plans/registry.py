"""Feature sets by region: what is measured, what it needs, and whether it is on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.functions.columns import dealt
from osseo.operators import artifacts as A, chain as C, hips as H, landmarks as M, levels as L, measures as Q, neighbourhood as N, pixels as P, spinous as SP

REGIONS = ("spine", "hip")
#: What providers may find; a frame without it gets what the set says.
PROVIDED = ("points", "bodies", "levels", "landmarks")
NEEDS = ("masked", "rows", "bone", *PROVIDED)


@dataclass(frozen=True)
class FeatureSet:
    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    regions: tuple[str, ...] = REGIONS
    needs: tuple[str, ...] = ("masked",)
    enabled: bool = True
    note: str = ""


_SETS: dict[str, FeatureSet] = {}


def register(feature_set: FeatureSet) -> FeatureSet:
    if unknown := {*feature_set.needs} - {*NEEDS} | {*feature_set.regions} - {*REGIONS}:
        raise ValueError(f"{feature_set.name}: unknown needs or regions {sorted(unknown)}")
    _SETS[feature_set.name] = feature_set
    return feature_set


def for_region(region: str) -> list[FeatureSet]:
    kind = "hip" if region.startswith("hip") else region
    return [s for s in _SETS.values() if s.enabled and kind in s.regions]


def describe(spark: SparkSession) -> DataFrame:
    """The registry as a table, enabled sets first."""
    rows = [(s.name, ",".join(s.regions), ",".join(s.needs), s.enabled, s.note) for s in _SETS.values()]
    return spark.createDataFrame(rows, "name string, regions string, needs string, enabled boolean, note string").orderBy(F.col("enabled").desc(), "name")


def features_long(masked: DataFrame, region: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """frame_id, feature, value of all sets of a region; a feature that two sets produce is an error.

    ``masked`` holds the frames of that region. It is read by every set, so it is dealt by frame and saved, and so are its rows
    and its largest component with filled rows. ``given`` holds what providers found (PROVIDED): points of the chain (frame_id, y, px),
    body angles (frame_id, vb_axis_deg, vb_n), a level map (frame_id, y, x, level), landmarks (frame_id, points, a map), each for
    the frames that it has; sets say what a frame without them gets.
    """
    masked = dealt(masked, P.FRAME)
    inputs = {"masked": masked, "rows": dealt(P.row_profile(masked), P.FRAME), "bone": dealt(H.row_filled(N.largest(masked)), P.FRAME)} | (given or {})
    out, seen = None, set()
    for s in for_region(region):
        got = s.build(inputs)
        names = [c for c, kind in got.dtypes if c != P.FRAME and kind == "double" and not c.startswith("_")]
        if clash := seen & {*names}:
            raise ValueError(f"{s.name}: features {sorted(clash)} exist already")
        seen |= {*names}
        part = got.select(P.FRAME, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names))).alias("f")).select(P.FRAME, "f.feature", "f.value").where("value IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def _or_else(frames: DataFrame, found: DataFrame | None, values: dict[str, float]) -> DataFrame:
    """The columns of ``found`` for every frame, ``values`` where it has none."""
    every = frames.select(P.FRAME).distinct()
    if found is None:
        return every.select(P.FRAME, *(F.lit(v).alias(c) for c, v in values.items()))
    return every.join(found, P.FRAME, "left").select(P.FRAME, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in values.items()))


def _levels(d: dict[str, DataFrame]) -> DataFrame:
    names = ("gap_top_bodies", "gap_bot_bodies", "tilt_ends", "tilt_resid", "aspect_med", "aspect_slope", "width_slope", "lr_asym", "body_h_px")
    return _or_else(d["masked"], Q.vertebra_levels(d["levels"]) if "levels" in d else None, {f"vl_{n}": -1.0 for n in names})


def _landmarks(d: dict[str, DataFrame]) -> DataFrame:
    every = d["masked"].groupBy(P.FRAME).agg((F.max("y") + 1).alias("h"))
    if "landmarks" not in d:
        return every.select(P.FRAME, F.lit(1.0).alias("lmk_empty"))
    line = Q.medial_line(d["bone"]).select(P.FRAME, F.struct("k", "c").alias("line"))
    both = every.join(d["landmarks"].select(P.FRAME, "points"), P.FRAME, "left").join(line, P.FRAME, "left")
    return both.select(P.FRAME, Q.landmark_rules(F.col("points"), F.col("h"), F.col("line")).alias("r")).select(P.FRAME, "r.*")


def _chain(d: dict[str, DataFrame]) -> DataFrame:
    if "points" not in d:
        return _or_else(d["masked"], None, {"kp_wing_vis": 1.0, "kp_wing_absent": 0.0, "kp_art_frac": 0.0})
    return C.chain_features(d["masked"], d["points"])


register(FeatureSet("geometry", lambda d: P.silhouette(d["masked"]).join(P.curvature(d["masked"]), P.FRAME).join(P.axis_orientation(d["masked"]).select(P.FRAME, "axis_deg"), P.FRAME, "left").join(N.contour_count(d["masked"]), P.FRAME)))
register(FeatureSet("visibility", lambda d: P.visibility(d["masked"])))
register(FeatureSet("thin_bright", lambda d: A.outside(d["masked"])))
register(FeatureSet("vertebra_count", lambda d: P.vertebra_count(d["masked"])))
register(FeatureSet("arcs", lambda d: A.arcs(d["masked"])))
register(FeatureSet("frame_offset", lambda d: Q.frame_offset(d["masked"])))
register(FeatureSet("spine_axis", lambda d: P.centre_line(P.row_profile(d["bone"]), frames=d["masked"]), ("spine",), ("bone",)))
register(FeatureSet("spine_disc_heuristic", lambda d: Q.spacing(P.peaks(d["rows"]), d["rows"].groupBy(P.FRAME).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))), ("spine",), ("rows",)))
register(FeatureSet("spine_vertebrae", lambda d: P.spine_column(d["bone"]), ("spine",), ("bone",)))
register(FeatureSet("spine_axis_bodies", lambda d: _or_else(d["masked"], d.get("bodies"), {"vb_axis_deg": -1.0, "vb_n": 0.0}), ("spine",), ("masked", "bodies")))
register(FeatureSet("spine_levels", lambda d: L.spine_levels(d["masked"], d["bone"], P.peaks(d["rows"]).select(P.FRAME, "y")), ("spine",), ("masked", "rows", "bone")))
register(FeatureSet("kp_spine", _chain, ("spine",), ("masked", "points")))
register(FeatureSet("vert_levels", _levels, ("spine",), ("masked", "levels")))
register(FeatureSet("femur_shape", lambda d: H.femur_shape(d["bone"]), ("hip",), ("bone",)))
register(FeatureSet("femur_medial", lambda d: H.medial_contrast(d["bone"]), ("hip",), ("bone",)))
register(FeatureSet("femur_points", lambda d: M.femur_points(d["bone"]), ("hip",), ("bone",)))
register(FeatureSet("proximal_grid", lambda d: H.grid_features(d["bone"], N.shaft_widths(d["bone"])), ("hip",), ("bone",)))
register(FeatureSet("hip_landmark_rules", _landmarks, ("hip",), ("masked", "bone", "landmarks")))
register(FeatureSet("field_of_view", lambda d: P.field_of_view(d["masked"]), enabled=False, note="worse in validation"))
register(FeatureSet("phase", lambda d: Q.phase(d["rows"], P.period(d["rows"])), ("spine",), ("rows",), enabled=False, note="worse in nested validation"))
register(FeatureSet("trochanter_density", lambda d: H.trochanter_density(d["bone"]), ("hip",), ("bone",), enabled=False, note="no gain in validation"))
register(FeatureSet("hip_side_margins", lambda d: P.side_margins(d["masked"]), ("hip",), enabled=False, note="no gain in validation"))
register(FeatureSet("spinous_offset", lambda d: SP.spinous_ridge(d["masked"], N.largest(d["masked"])), ("spine",), enabled=False, note="the ridge does not improve the axis in validation"))
register(FeatureSet("artifact_inside", lambda d: A.inside(d["masked"]), enabled=False, note="no metal inside bones in the labels"))
