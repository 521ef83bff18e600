"""Least-squares fits over point tables, as grouped sums and closed forms."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import geometry as G


def _all_of(*columns: str) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def _about_means(a: str, b: str, rows: Column) -> Column:
    """Aggregate: over ``rows``, the sum of products of ``a`` and ``b`` less their means, which are over all rows that have them."""
    x, y, n = F.when(rows, F.col(a)), F.when(rows, F.col(b)), F.count_if(rows)
    return n * F.covar_pop(x, y) + n * (F.avg(x) - F.avg(a)) * (F.avg(y) - F.avg(b))


def fit_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Similarity (no reflection) from (fx, fy) to (tx, ty) per group; null when degenerate."""
    # co-moments are merged from the parts of a group, so the pairs are read once and do not move
    points, both = _all_of("fx", "fy"), _all_of("fx", "fy", "tx", "ty")
    known = reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True))
    s = pairs.filter(known).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("fx", "fy", "tx", "ty")],
        (_about_means("fx", "tx", both) + _about_means("fy", "ty", both)).alias("dot"),
        (_about_means("fx", "ty", both) - _about_means("fy", "tx", both)).alias("cross"),
        (_about_means("fx", "fx", points) + _about_means("fy", "fy", points)).alias("var"),
    )
    size = G.length(F.col("dot"), F.col("cross"))
    angle = F.atan2("cross", "dot")
    scale = size / F.col("var")
    ok = (F.col("n") >= 2) & (F.col("var") > 0) & (size > 0)
    u = scale * (F.cos(angle) * F.col("m_fx") - F.sin(angle) * F.col("m_fy"))
    v = scale * (F.sin(angle) * F.col("m_fx") + F.cos(angle) * F.col("m_fy"))
    t = G.similarity(F.col("m_tx") - u, F.col("m_ty") - v, G.normalise_deg(F.degrees(angle)), scale)
    return s.select(*keys, F.when(ok, t).alias("transform"))


# Fixed value: points count as collinear when the determinant is below this share of its terms.
DEGENERATE = 1e-12


def fit_circle(points: DataFrame, keys: list[str]) -> DataFrame:
    """Circle through points (x, y) per group by least squares, with the rms residual; null when collinear."""
    means = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    q = x * x + y * y
    s = points.join(means, keys).groupBy(*keys).agg(
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.sum(x * q).alias("sxq"), F.sum(y * q).alias("syq"), F.sum(q).alias("sq"),
    ).join(means, keys)
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    cx = (F.col("syy") * F.col("sxq") - F.col("sxy") * F.col("syq")) / (2 * det)
    cy = (F.col("sxx") * F.col("syq") - F.col("sxy") * F.col("sxq")) / (2 * det)
    r2 = cx * cx + cy * cy + F.col("sq") / F.col("n")
    ok = (F.col("n") >= 3) & (F.abs(det) > DEGENERATE * (F.col("sxx") * F.col("syy") + 1e-300))
    circle = s.select(
        *keys, "n", F.when(ok, cx + F.col("mx")).alias("cx"), F.when(ok, cy + F.col("my")).alias("cy"), F.when(ok, F.sqrt(r2)).alias("r")
    )
    e = G.length(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")
    rms = points.join(circle, keys).groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rms_px"))
    return circle.join(rms, keys)


def phase_for_click(phase_deg: Column, n: Column, click_deg: Column) -> Column:
    """The ring phase that puts the nearest generated hole under a click."""
    step = 360 / n
    k = F.floor(G.angle_difference_deg(click_deg, phase_deg) / step + 0.5)
    return G.normalise_deg(click_deg - k * step)


def ring_turn(phase_deg: Column, n: Column, click_deg: Column) -> Column:
    """How far that turns the ring, the short way."""
    return G.angle_difference_deg(phase_for_click(phase_deg, n, click_deg), phase_deg)


def target_turn(n: Column, current: Column, clicked: Column) -> Column:
    """Whole holes from the current target to a clicked hole, the short way; null without a current target."""
    half = F.floor(n / 2)
    return F.pmod(F.pmod(clicked - current, n) + half, n) - half
