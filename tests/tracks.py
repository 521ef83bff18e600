"""Scripted tracks: a list of frames per video turned into the input tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wayfare.plans.derive import Inputs
from catalog import benchmark as B

CX, CY, R = B.PLATFORM
NOWHERE = None


def hole(k: int, inwards_cm: float = 0.0) -> tuple[float, float]:
    a = 2 * math.pi * k / 20
    d = R * B.RING_RATIO - inwards_cm * B.PX_PER_CM
    return CX + d * math.cos(a), CY + d * math.sin(a)


def walk(a, b, n):
    return [(a[0] + (b[0] - a[0]) * (i + 1) / n, a[1] + (b[1] - a[1]) * (i + 1) / n) for i in range(n)]


def visit(*holes: int, dwell: int = 20, step: int = 30):
    """Frames from the centre to each hole in turn, dwelling at each."""
    at, out = (CX, CY), [(CX, CY)] * 5
    for k in holes:
        out += walk(at, hole(k), step) + [hole(k)] * dwell
        at = hole(k)
    return out


def tables(spark, videos: dict[str, list], fps: float = 30.0, corrections: list[dict] | None = None, trial_type="acquisition") -> Inputs:
    """Inputs of one session; a frame is None (lost), (x, y), or a dict with x, y, state, reason, nose, t."""
    rows = []
    for vid, frames in videos.items():
        for i, f in enumerate(frames):
            d = f if isinstance(f, dict) else ({} if f is None else {"x": f[0], "y": f[1]})
            ok = "x" in d
            x, y = d.get("x", 0.0), d.get("y", 0.0)
            nose = d.get("nose")
            state = d.get("state", "tracked" if ok else "not_detected")
            rows.append((
                "s", vid, i, i, d.get("t", i / fps), (float(x), float(y), 0.9, ok, "auto"),
                (float(nose[0]) if nose else 0.0, float(nose[1]) if nose else 0.0, 0.5, nose is not None, "auto"),
                state, d.get("reason", "single_blob" if ok else "no_foreground"), 500.0, 0.5 if nose else 0.0, None,
            ))
    point = "struct<x:double,y:double,confidence:double,valid:boolean,source:string>"
    frames = spark.createDataFrame(
        rows,
        f"session_id string, video_id string, pos int, frame_index int, t_s double, centroid {point}, nose {point}, detection_state string, "
        "reason string, blob_area_px2 double, nose_heading_confidence double, bounding_box struct<x:double,y:double,width:double,height:double>",
    )
    vids = spark.createDataFrame([("s", v, i, f"{v}.mp4") for i, v in enumerate(videos)], "session_id string, video_id string, video_order int, filename string")
    vids = vids.select(
        "*", F.lit("map-0").alias("map_id"), F.lit(trial_type).alias("trial_type"), F.lit(None).cast("int").alias("target_hole"),
        F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("resolution"),
        F.struct(F.lit(0.0).alias("translate_x"), F.lit(0.0).alias("translate_y"), F.lit(0.0).alias("rotation_deg"), F.lit(1.0).alias("scale")).alias("transform"),
        F.lit("M1").alias("animal"), F.lit("1").alias("day"), F.lit("1").alias("trial"), F.lit("g").alias("group"),
    )
    schema = ", ".join(f"{c} {t}" for c, t in B.CORRECTION_COLUMNS.items())
    entries = [
        tuple({"session_id": "s", "timestamp": f"2026-01-01T00:00:{i:02d}Z", **c}.get(k) for k in B.CORRECTION_COLUMNS) for i, c in enumerate(corrections or [])
    ]
    return Inputs(frames, vids, B.maze_maps(spark), spark.createDataFrame(entries, schema))
