"""Spatial neighbour joins as tables of their own: equality on cells, then the exact test."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COLUMNS, DEFAULT, RINGS
from ..functions.scalars import beta, cell, image_column, in_image, ring_step
from .frames import Frame, nearest_within, pairs_within, per_frame

C = F.col


def grid_cells(points: DataFrame, size: float = DEFAULT.grid_resolution, max_range: float = DEFAULT.max_range) -> DataFrame:
    """Occupied cells of the plane: (frame_id, cx, cy, n, first_idx)."""
    inside = (F.abs("x") <= max_range) & (F.abs("y") <= max_range)
    return points.filter(inside).groupBy("frame_id", cell(C("x"), size).alias("cx"), cell(C("y"), size).alias("cy")).agg(F.count("*").alias("n"), F.min("point_idx").alias("first_idx"))


def touching_cells(cells: DataFrame) -> DataFrame:
    """Pairs of occupied cells that touch at a side or corner, each once: (frame_id, cx, cy, nx, ny)."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in product((-1, 0, 1), repeat=2) if (a, b) > (0, 0)))
    asked = cells.select("frame_id", "cx", "cy", F.explode(offsets).alias("o")).select("frame_id", "cx", "cy", (C("cx") + C("o.dx")).alias("nx"), (C("cy") + C("o.dy")).alias("ny"))
    return asked.join(cells.select("frame_id", C("cx").alias("nx"), C("cy").alias("ny")), ["frame_id", "nx", "ny"]).select("frame_id", "cx", "cy", "nx", "ny")


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs a < b of points of a frame within `radius`: one shuffle by frame, and in it cells of that size, of which
    half of the 27 neighbours hold each pair once."""

    def kernel(f: Frame) -> Frame:
        xyz, idx = np.stack([f["x"], f["y"], f["z"]], 1), f["point_idx"]
        i, j = pairs_within(xyz, radius)
        return {"a": idx[i], "b": idx[j], "d2": ((xyz[i] - xyz[j]) ** 2).sum(1)}

    return per_frame(points.select("frame_id", "point_idx", "x", "y", "z"), kernel, "frame_id bigint, a bigint, b bigint, d2 double")


def nearest_neighbours(points: DataFrame, k: int, reach: float) -> DataFrame:
    """(frame_id, point_idx, rank, nbr, d) of the k nearest points of each, itself at rank 0, ties by index. All of it is
    one kernel per frame, which is dealt once: neighbours are sought within `reach`, and within twice that for points that
    have fewer than k there, up to the whole frame, so none is missed."""

    def kernel(f: Frame) -> Frame:
        i, j, rank, d2 = nearest_within(np.stack([f["x"], f["y"], f["z"]], 1), k, reach)
        return {"point_idx": f["point_idx"][i], "rank": rank, "nbr": f["point_idx"][j], "d": np.sqrt(np.maximum(0.0, d2))}

    return per_frame(points.select("frame_id", "point_idx", "x", "y", "z"), kernel, "frame_id bigint, point_idx bigint, rank int, nbr bigint, d double")


def range_image(points: DataFrame) -> DataFrame:
    """(frame_id, ring, col, point_idx, d): the nearest return of each pixel, the earlier of two."""
    d = F.sqrt(C("x") * C("x") + C("y") * C("y") + C("z") * C("z"))
    p = points.filter(in_image(C("ring"))).select("frame_id", "ring", image_column(C("x"), C("y")).alias("col"), F.struct(d.alias("d"), "point_idx").alias("p"))
    return p.groupBy("frame_id", "ring", "col").agg(F.min("p").alias("p")).select("frame_id", "ring", "col", "p.point_idx", "p.d")


def image_edges(image: DataFrame, theta_deg: float = DEFAULT.depth_theta_thr) -> DataFrame:
    """Directed steps a -> b that depth growing may take: two rings and columns around, columns wrap, and the angle at the
    farther return is above the limit."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in product(range(-2, 3), repeat=2) if a or b))
    left = image.select("frame_id", C("ring").alias("r0"), C("point_idx").alias("a"), C("d").alias("d0"), "col", F.explode(offsets).alias("o"))
    left = left.withColumns({"ring": C("r0") + C("o.dr"), "col": F.pmod(C("col") + C("o.dc"), F.lit(COLUMNS))}).filter((C("ring") >= 0) & (C("ring") < RINGS))
    wide = F.lit(2.0 * 3.141592653589793 / COLUMNS)
    alpha = F.when(C("o.dr") != 0, F.abs("o.dr") * ring_step(C("r0"))).otherwise(F.abs("o.dc") * wide)
    met = left.join(image.select("frame_id", "ring", "col", C("point_idx").alias("b"), C("d").alias("d1")), ["frame_id", "ring", "col"])
    return met.withColumn("beta", beta(C("d0"), C("d1"), alpha)).filter(C("beta") > theta_deg * 3.141592653589793 / 180.0).select("frame_id", "a", "b", "beta")
