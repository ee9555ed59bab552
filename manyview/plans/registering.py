"""Alignment of several reconstructions, by cameras and by points, and rigid fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Recon
from ..operators import align, matching, metrics
from ..operators import registration as R
from . import roles
from . import transforms as S
from .registry import query, r6

#: Reconstructions in the order in which they overlap; number k has the images of residues k and k + 1.
CHAIN = (0, 2, 1, 3)
RESIDUES = len(CHAIN) + 1


def _frame(recon: int) -> align.Similarity:
    """Takes coordinates of a reconstruction to the common frame; the first is that frame."""
    return align.Similarity.from_axis_angle((0.2, 0.3, 1.0), 0.4 * recon, (1.0 * recon, -2.0 * recon, 0.5 * recon), 1.0 + 0.25 * recon)


def _native_images(spark, sf) -> DataFrame:
    images = roles.images(spark, sf)
    parts = []
    for k, recon in enumerate(CHAIN):
        own = images.filter((F.col("image_id") % RESIDUES).isin(k, k + 1))
        parts.append(align.transform_poses(own, _frame(recon).inverse()).select(F.lit(recon).cast("long").alias("recon"), "image_id", "name", *R.POSE))
    return reduce(DataFrame.unionByName, parts)


CHAIN_SQL = f"""
chain AS (SELECT unnest({list(CHAIN)}) AS recon, unnest(range({len(CHAIN)})) AS k),
reach AS (
  SELECT 0 AS k, 0 AS sweep
  UNION ALL
  SELECT r.k + 1, CASE WHEN r.sweep >= 1 AND a.recon < b.recon THEN r.sweep ELSE r.sweep + 1 END
  FROM reach r JOIN chain a ON a.k = r.k JOIN chain b ON b.k = r.k + 1),
recons AS (SELECT recon::BIGINT AS recon, k, sweep FROM chain JOIN reach USING (k))
"""


@query(
    "multi_alignment",
    roles.sql(
        roles.IMAGES_SQL, roles.CENTERS_SQL, CHAIN_SQL,
        body=f"""SELECT recon, sweep, image_id, round(cx, 5) + 0.0 AS cx, round(cy, 5) + 0.0 AS cy, round(cz, 5) + 0.0 AS cz
                 FROM centers JOIN recons ON image_id % {RESIDUES} IN (k, k + 1)""",
    ),
)
def multi_alignment(spark, sf):
    """Camera centres of four overlapping reconstructions in the frame of the first, and the sweep that took each."""
    images = _native_images(spark, sf)
    fits = R.align_all(images, 0)
    moved = metrics.with_centers(R.move_images(images, fits)).join(fits.select("recon", "sweep"), "recon")
    return moved.select("recon", "sweep", "image_id", *[(r6(c, c, 5) + 0.0).alias(c) for c in ("cx", "cy", "cz")])


@query(
    "multi_alignment_points",
    roles.sql(
        roles.POINTS_SQL, CHAIN_SQL,
        body=f"""SELECT recon, point_id, round(x, 8) + 0.0 AS x, round(y, 8) + 0.0 AS y, round(z, 8) + 0.0 AS z, w FROM points JOIN recons ON recon = point_id % {len(CHAIN)}""",
    ),
)
def multi_alignment_points(spark, sf):
    """Points of the four reconstructions, a quarter each, in the frame of the first."""
    points = roles.points(spark, sf)
    native = [
        align.transform_points(points.filter(F.col("point_id") % len(CHAIN) == recon), _frame(recon).inverse())
        .select(F.lit(recon).cast("long").alias("recon"), "point_id", "x", "y", "z", "w")
        for recon in CHAIN
    ]
    moved = R.move_points(reduce(DataFrame.unionByName, native), R.align_all(_native_images(spark, sf), 0))
    return moved.select("recon", "point_id", *[(r6(c, c, 8) + 0.0).alias(c) for c in "xyz"], "w")


TARGET = align.Similarity.from_axis_angle((1.0, -0.5, 0.3), 0.8, (4.0, -3.0, 2.0), 1.5)


def _moved_sql(sim: align.Similarity, names: str = "xyz") -> list[str]:
    r, t = sim.rotation, sim.translation
    return [f"{sim.scale!r} * (" + " + ".join(f"({float(r[i, k])!r}) * {n}" for k, n in enumerate(names)) + f") + ({float(t[i])!r})" for i in range(3)]


def _columns(exprs: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for e, n in zip(exprs, "xyz"))


def _both(spark, sf) -> tuple[Recon, Recon]:
    """A reconstruction and the same moved, with other point ids and some points far off."""
    source = roles.recon(spark, sf)
    far = F.when((F.col("point_id") % 29 == 0) & (F.col("w") != 0), 40.0).otherwise(0.0)
    points = align.transform_points(source.points, TARGET).withColumn("y", F.col("y") + far)
    other = lambda df: df.withColumn("point_id", F.col("point_id") + 10_000_000)
    return source, Recon(align.transform_poses(source.images, TARGET), other(points), other(source.obs))


@query("align_by_points", roles.sql(roles.POINTS_SQL, body=f"SELECT point_id, {_columns(_moved_sql(TARGET))} FROM points WHERE w <> 0"))
def align_by_points(spark, sf):
    """Finite points moved by the similarity from corresponding points, one in 29 of which is far off."""
    source, target = _both(spark, sf)
    images = source.images.select(F.col("image_id").alias("ord"), F.col("image_id").alias("source_image"), F.col("image_id").alias("target_image"))
    met = matching.correspondences_by_feature(source.obs, target.obs, images)
    place = lambda df, key, names: df.filter("w <> 0").select(F.col("point_id").alias(key), *[F.col(c).alias(n) for c, n in zip("xyz", names)])
    pairs = met.join(place(source.points, "source_point", ("sx", "sy", "sz")), "source_point").join(place(target.points, "target_point", ("tx", "ty", "tz")), "target_point")
    fit, _, _ = R.fit_by_points(R.cut(pairs.withColumnRenamed("source_point", "pair_id")))
    out = align.transform_points(source.points.filter("w <> 0"), fit)
    return out.select("point_id", *[(r6(c, c, 4) + 0.0).alias(c) for c in "xyz"])


@query("align_to_step", roles.sql(roles.IMAGES_SQL, roles.CENTERS_SQL, body=f"SELECT image_id, {_columns(_moved_sql(TARGET, ('cx', 'cy', 'cz')))} FROM centers"))
def align_to_step(spark, sf):
    """Camera centres after the transform step that aligns to another reconstruction by cameras."""
    source, target = _both(spark, sf)
    out = metrics.with_centers(source.transform(S.align_to(target)).images)
    return out.select("image_id", *[(F.round(f"c{c}", 4) + 0.0).alias(c) for c in "xyz"])


_RIGID = align.Similarity(TARGET.rotation, TARGET.translation, 1.0)


@query(
    "rigid_alignment",
    roles.sql(
        roles.POINTS_SQL,
        body=f"""
        , f AS (SELECT * FROM points WHERE w <> 0), m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM f),
        d AS (SELECT point_id, f.x - m.x AS x, f.y - m.y AS y, f.z - m.z AS z, m.x AS mx, m.y AS my, m.z AS mz FROM f, m)
        SELECT point_id, {_columns([f"{a} + {TARGET.scale!r} * ({b} - ({float(t)!r}))" for a, b, t in zip(_moved_sql(_RIGID), _moved_sql(_RIGID, ("mx", "my", "mz")), TARGET.translation)])} FROM d
        """,
    ),
)
def rigid_alignment(spark, sf):
    """Points moved by the best transform without scale onto a scaled copy: turned, and centre on centre."""
    source, _ = _both(spark, sf)
    finite = source.points.filter("w <> 0")
    s = finite.select("point_id", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    t = align.transform_points(finite, TARGET).select("point_id", *[F.col(c).alias(f"t{c}") for c in "xyz"])
    out = align.transform_points(finite, align.fit_similarity(s.join(t, "point_id"), estimate_scale=False))
    return out.select("point_id", *[(r6(c, c, 4) + 0.0).alias(c) for c in "xyz"])


#: Two fragments by the last digit of the image, each under a similarity of its own; the other images are off one by one.
_PARTS = (
    align.Similarity.from_axis_angle((0.0, 0.0, 1.0), 0.5, (1.0, 2.0, 3.0), 1.2),
    align.Similarity.from_axis_angle((1.0, 0.0, 1.0), 1.7, (-30.0, 5.0, 9.0), 0.8),
)
SCENE = 10.0


def _fragments_sql() -> str:
    a, b = (_moved_sql(p, ("cx", "cy", "cz")) for p in _PARTS)
    shift = "40.0 + 7.0 * (image_id % 97)"
    goal = [f"CASE WHEN image_id % 10 BETWEEN 1 AND 5 THEN {x} WHEN image_id % 10 BETWEEN 6 AND 8 THEN {y} ELSE {x}{' + ' + shift if k == 1 else ''} END" for k, (x, y) in enumerate(zip(a, b))]
    return f"""
    , t AS (SELECT *, {', '.join(f'{e} AS g{n}' for e, n in zip(goal, 'xyz'))}, {', '.join(f'{e} AS m{n}' for e, n in zip(a, 'xyz'))} FROM centers)
    SELECT image_id AS id, CASE WHEN image_id % 10 BETWEEN 1 AND 5 THEN 1 WHEN image_id % 10 BETWEEN 6 AND 8 THEN 2 END AS component,
      CASE WHEN image_id % 10 BETWEEN 1 AND 8 THEN 0.0 ELSE round(100.0 / {SCENE} * sqrt((gx - mx) * (gx - mx) + (gy - my) * (gy - my) + (gz - mz) * (gz - mz)), 2) END AS position_error,
      0.0::DOUBLE AS rotation_error FROM t"""


@query("rigid_fragments", roles.sql(roles.IMAGES_SQL, roles.CENTERS_SQL, body=_fragments_sql()))
def rigid_fragments(spark, sf):
    """Images of a scene split into the parts that were moved alike."""
    images = roles.images(spark, sf)
    digit = F.col("image_id") % 10
    first = align.transform_poses(images.filter(~digit.isin(6, 7, 8)), _PARTS[0])
    both = metrics.with_centers(first.unionByName(align.transform_poses(images.filter(digit.isin(6, 7, 8)), _PARTS[1])))
    away = F.when(digit.isin(9, 0), 40.0 + 7.0 * (F.col("image_id") % 97)).otherwise(0.0)
    named = lambda df, tag, cols: df.select("image_id", *[F.col(q).alias(f"{tag}_{q}") for q in R.POSE[:4]], *[F.col(f"c{k}").alias(n) for k, n in zip("xyz", cols)])
    goal = named(both.withColumn("cy", F.col("cy") + away), "t", ("cx", "cy", "cz"))
    source = named(metrics.with_centers(images), "s", ("sx", "sy", "sz"))
    out = R.rigid_fragments(source.join(goal, "image_id").withColumnRenamed("image_id", "id"), SCENE, R.FragmentLimits(min_size=3))
    return out.select("id", "component", (F.round("position_error", 2) + 0.0).alias("position_error"), (F.round("rotation_error", 2) + 0.0).alias("rotation_error"))
