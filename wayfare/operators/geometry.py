"""Per-video maze geometry: one row per video with the ring, radii and zones in pixels."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import geometry as G
from wayfare.operators.timeline import KEY


def transform_offsets(offsets: Column, t: Column) -> Column:
    def moved(o: Column) -> Column:
        dx, dy = G.apply_vector(t, o["dx_px"], o["dy_px"])
        return F.struct(o["hole_index"].alias("hole_index"), dx.alias("dx_px"), dy.alias("dy_px"))

    return F.transform(offsets, moved)


def place_map(maps: DataFrame, transform: Column, resolution: Column) -> DataFrame:
    """Move a whole map: lengths scale, the phase turns, the offsets turn and scale."""
    cx, cy = G.apply_point(transform, F.col("platform.cx"), F.col("platform.cy"))
    return (
        maps.withColumn("__t", transform)
        .withColumn(
            "platform",
            F.struct(cx.alias("cx"), cy.alias("cy"), (F.col("platform.r") * F.col("__t.scale")).alias("r")),
        )
        .withColumn("hole_radius_px", F.col("hole_radius_px") * F.col("__t.scale"))
        .withColumn("phase_deg", G.normalise_deg(F.col("phase_deg") + F.col("__t.rotation_deg")))
        .withColumn("offsets", transform_offsets(F.col("offsets"), F.col("__t")))
        .withColumn("resolution", resolution)
        .drop("__t")
    )


def hole_ring(maps: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hole of each map."""
    holes = G.hole_centres(
        F.col("platform.cx"), F.col("platform.cy"), F.col("platform.r") * F.col("ring_ratio"),
        F.col("n"), F.col("phase_deg"), F.col("offsets"),
    )
    return maps.select(*keys, F.explode(holes).alias("h")).select(*keys, "h.*").withColumnRenamed("k", "hole_index")


def effective_target(video_target: Column, map_target: Column) -> Column:
    return F.coalesce(video_target, map_target)


def drop_missing_targets(videos: DataFrame, n_holes: Column) -> DataFrame:
    """Clear a video's own target when the map has no such hole."""
    t = F.col("target_hole")
    return videos.withColumn("target_hole", F.when((t >= 0) & (t < n_holes), t))


def geometry(videos: DataFrame, maps: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The geometry bundle of every video; ``problem`` says why a video has none."""
    m = maps.select(
        "map_id", "platform", "n", "ring_ratio", "hole_radius_px", "phase_deg", "offsets",
        F.col("target_hole").alias("map_target"), "platform_diameter_cm", "resolution",
    )
    v = videos.select(
        *KEY, "map_id", "transform", F.col("target_hole").alias("own_target"), "trial_type",
        F.col("resolution").alias("video_resolution"),
    )
    joined = v.join(m, "map_id", "left")
    t, target = F.col("transform"), F.col("own_target")
    whole = lambda c: (c >= 0) & (c < F.col("n"))
    problem = F.coalesce(
        F.when(F.col("n").isNull(), F.lit("the session has no maze map")),
        F.when(F.col("n") < 1, F.lit("the map must have at least one hole")),
        F.when(~whole(F.col("map_target")), F.lit("the map's target must name one of its holes")),
        F.when(~(t["scale"] > 0), F.lit("the transform's scale must be positive")),
        F.when(target.isNotNull() & ~whole(target), F.lit("the video's target must name one of the holes")),
        F.when(
            ~((F.col("platform.r") > 0) & (F.col("platform_diameter_cm") > 0)),
            F.lit("no scale: platform radius or diameter is not above zero"),
        ),
        F.when(~(F.col("hole_radius_px") > 0), F.lit("the hole radius must be positive")),
    )
    placed = place_map(joined.withColumn("problem", problem), t, F.col("video_resolution"))
    cx, cy, r = F.col("platform.cx"), F.col("platform.cy"), F.col("platform.r")
    ring = r * F.col("ring_ratio")
    usable = F.col("problem").isNull()
    placed = placed.withColumn(
        "holes",
        F.when(usable, G.hole_centres(cx, cy, ring, F.col("n"), F.col("phase_deg"), F.col("offsets"))),
    ).withColumn("target", F.when(usable, effective_target(target, F.col("map_target"))))
    hole = F.element_at("holes", (F.col("target") + 1).cast("int"))
    hr = F.col("hole_radius_px")
    return placed.select(
        *KEY,
        "problem",
        "trial_type",
        cx.alias("pcx"),
        cy.alias("pcy"),
        r.alias("pr"),
        F.col("n").alias("n_holes"),
        "holes",
        F.col("target").cast("int").alias("target"),
        hr.alias("hole_r_px"),
        ring.alias("ring_px"),
        G.px_per_cm(r, F.col("platform_diameter_cm")).alias("px_per_cm"),
        F.col("platform_diameter_cm"),
        G.angle_at(cx, cy, hole["x"], hole["y"]).alias("sector_deg"),
        (F.lit(float(p["targetQuadrant"]["holeSpan"])) * 360 / F.col("n")).alias("sector_half"),
        (F.lit(float(p["strategy"]["centreZoneRadiusFraction"])) * r).alias("centre_zone_px"),
        (F.lit(float(p["holeInvestigation"]["radiusFactor"])) * hr).alias("inv_px"),
        (F.lit(float(p["escapeEntry"]["radiusFactor"])) * hr).alias("esc_px"),
        hr.alias("fill_px"),
    )
