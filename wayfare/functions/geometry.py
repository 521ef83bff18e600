"""Column functions of plane geometry: similarity transforms, the hole ring and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_deg(d: Column) -> Column:
    return F.pmod(d, F.lit(360.0))


def angle_difference_deg(a: Column, b: Column) -> Column:
    d = normalise_deg(a - b)
    return F.when(d > 180, d - 360).otherwise(d)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def similarity(tx: Column, ty: Column, rotation_deg: Column, scale: Column) -> Column:
    return F.struct(
        tx.alias("translate_x"), ty.alias("translate_y"), rotation_deg.alias("rotation_deg"), scale.alias("scale")
    )


def apply_vector(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    s, c = F.sin(F.radians(t["rotation_deg"])), F.cos(F.radians(t["rotation_deg"]))
    return t["scale"] * (c * x - s * y), t["scale"] * (s * x + c * y)


def apply_point(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    u, v = apply_vector(t, x, y)
    return u + t["translate_x"], v + t["translate_y"]


def invert(t: Column) -> Column:
    scale = 1 / t["scale"]
    turn = similarity(F.lit(0.0), F.lit(0.0), -t["rotation_deg"], scale)
    u, v = apply_vector(turn, t["translate_x"], t["translate_y"])
    return similarity(-u, -v, normalise_deg(-t["rotation_deg"]), scale)


def compose(outer: Column, inner: Column) -> Column:
    u, v = apply_point(outer, inner["translate_x"], inner["translate_y"])
    return similarity(
        u, v, normalise_deg(outer["rotation_deg"] + inner["rotation_deg"]), outer["scale"] * inner["scale"]
    )


def rotation_about(degrees: Column, cx: Column, cy: Column) -> Column:
    one = similarity(F.lit(0.0), F.lit(0.0), degrees, F.lit(1.0))
    u, v = apply_vector(one, cx, cy)
    return similarity(cx - u, cy - v, normalise_deg(degrees), F.lit(1.0))


def circle_to_circle(from_c: Column, to_c: Column) -> Column:
    """The transform that takes one circle onto another without turning; null unless both have a radius."""
    scale = to_c["r"] / from_c["r"]
    t = similarity(
        to_c["cx"] - scale * from_c["cx"], to_c["cy"] - scale * from_c["cy"], F.lit(0.0), scale
    )
    return F.when((from_c["r"] > 0) & (to_c["r"] > 0), t)


def resolution_ratio(from_width: Column, to_width: Column) -> Column:
    return similarity(
        F.lit(0.0), F.lit(0.0), F.lit(0.0),
        F.when(from_width > 0, to_width / from_width).otherwise(F.lit(1.0)),
    )


def px_per_cm(radius: Column, diameter_cm: Column) -> Column:
    return F.when((radius > 0) & (diameter_cm > 0), 2 * radius / diameter_cm)


def hole_radius_px(hole_diameter_cm: Column, scale: Column) -> Column:
    return hole_diameter_cm / 2 * scale


def ring_distance(a: Column, b: Column, n: Column) -> Column:
    """Holes between two holes, the short way round."""
    d = F.abs(a - b) % n
    return F.least(d, n - d)


def angle_at(cx: Column, cy: Column, x: Column, y: Column) -> Column:
    dx, dy = x - cx, y - cy
    return F.when((dx != 0) | (dy != 0), normalise_deg(F.degrees(F.atan2(dy, dx))))


def hole_centres(cx: Column, cy: Column, ring_radius: Column, n: Column, phase_deg: Column, offsets: Column) -> Column:
    """array<struct(k, x, y)> of the ring; ``offsets`` is array<struct(hole_index, dx_px, dy_px)> or null."""

    def centre(k: Column) -> Column:
        a = F.radians(normalise_deg(phase_deg + k * F.lit(360.0) / n))
        own = F.element_at(F.filter(offsets, lambda o: o["hole_index"] == k), -1)
        dx = F.coalesce(own["dx_px"], F.lit(0.0))
        dy = F.coalesce(own["dy_px"], F.lit(0.0))
        return F.struct(
            k.alias("k"),
            (cx + ring_radius * F.cos(a) + dx).alias("x"),
            (cy + ring_radius * F.sin(a) + dy).alias("y"),
            ((dx != 0) | (dy != 0)).alias("nudged"),
        )

    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), centre)


def nearest_hole(holes: Column, x: Column, y: Column) -> Column:
    """struct(d2, k) of the nearest hole; the lowest index wins a tie."""
    return F.array_min(
        F.transform(
            holes,
            lambda h: F.struct(
                ((x - h["x"]) * (x - h["x"]) + (y - h["y"]) * (y - h["y"])).alias("d2"), h["k"].alias("k")
            ),
        )
    )


def distance_to_hole(holes: Column, k: Column, x: Column, y: Column) -> Column:
    h = F.element_at(holes, (k + 1).cast("int"))
    return length(x - h["x"], y - h["y"])


def in_sector(cx: Column, cy: Column, centre_deg: Column, half_deg: Column, x: Column, y: Column) -> Column:
    """Inside the sector, edges included; the exact centre counts as inside."""
    dx, dy = x - cx, y - cy
    inside = F.abs(angle_difference_deg(F.degrees(F.atan2(dy, dx)), centre_deg)) <= half_deg
    return ((dx == 0) & (dy == 0)) | inside
