"""Motion compensation of sweeps: a trajectory integrated from inertial samples, applied to every point.

Points meet the samples of their frame once, grouped by frame; what else is needed is a row per frame. A task holds the
points of one frame and its samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import DEFAULT, TIME_GATE, UP_AXES, Config
from ..functions.rotation import matrix_of
from ..sources.tf import lookup_at
from .frames import Frame, per_frame
from .temporal import HALF_WINDOW, as_of, motion, window_join

C = F.col
#: Axes of the inertial unit in the sensor's frame: x, z, -y.
AXES = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, -1.0, 0.0]])
TRAJECTORY = "ts_ns bigint, qx double, qy double, qz double, qw double, px double, py double, pz double"


def outside_gate(ts: Column, ref: Column) -> Column:
    """Points too far from the frame's time stay as they are."""
    return F.abs(ts - ref) > TIME_GATE


def _rotated(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each v turned by its unit quaternion."""
    t = 2 * np.cross(q[:, :3], v)
    return v + q[:, 3:] * t + np.cross(q[:, :3], t)


def integrate(ts: np.ndarray, gyro: np.ndarray, accel: np.ndarray, target: int, v0: np.ndarray, lever: np.ndarray, gravity: np.ndarray, sign: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(quaternions, positions) at the samples, from rest of rotation and position at the sample nearest to target. Only
    the product of the turns goes step by step; speeds and places are running sums."""
    n, m = len(ts), int(np.argmin(np.abs(ts - target)))
    q, x = np.tile([0.0, 0.0, 0.0, 1.0], (n, 1)), np.zeros((n, 3))
    for at in (np.arange(m, n), np.arange(m, -1, -1)):  # forward, then backward
        k, j = at[:-1], at[1:]
        if not len(k):
            continue
        dt = (ts[j] - ts[k]) / 1e9
        dt = np.where((dt <= 0) | (dt > 0.1), 0.01, dt) if j[0] > m else np.where(np.abs(dt) > 0.1, -0.01, dt)
        w, a = ((gyro[k] + gyro[j]) / 2) @ AXES.T, ((accel[k] + accel[j]) / 2) @ AXES.T
        turn = w * dt[:, None]
        angle = np.linalg.norm(turn, axis=1)
        some = angle > 1e-8
        share = np.divide(np.sin(angle / 2), angle, out=np.zeros_like(angle), where=some)
        dq = np.column_stack([turn * share[:, None], np.where(some, np.cos(angle / 2), 1.0)])
        px, py, pz, pw = 0.0, 0.0, 0.0, 1.0
        out = []
        for bx, by, bz, bw in dq.tolist():
            px, py, pz, pw = pw * bx + px * bw + py * bz - pz * by, pw * by - px * bz + py * bw + pz * bx, pw * bz + px * by - py * bx + pz * bw, pw * bw - px * bx - py * by - pz * bz
            size = math.sqrt(px * px + py * py + pz * pz + pw * pw)
            px, py, pz, pw = px / size, py / size, pz / size, pw / size
            out.append((px, py, pz, pw))
        q[j] = out
        full = _rotated(q[k], a + np.cross(w, np.cross(w, lever))) + sign * gravity
        dt = dt[:, None]
        before = v0 + np.cumsum(np.vstack([np.zeros(3), full[:-1] * dt[:-1]]), axis=0)
        x[j] = np.cumsum(before * dt + full * dt * dt / 2, axis=0)
    return q, x


SAMPLE = ("wx", "wy", "wz", "ax", "ay", "az")
OF_FRAME = ("header_ts_ns", "vx", "vy", "vz", "qx", "qy", "qz", "qw", "lx", "ly", "lz")


def frame_motion(frames: DataFrame, edges: DataFrame, body: str = "lidar", cfg: Config = DEFAULT) -> DataFrame:
    """(frame_id, header_ts_ns, vx, vy, vz, qx ... qw, lx, ly, lz): velocity in the world and rotation to it at each frame,
    and the place of the inertial unit in the sensor's frame. The world is `odom` if the edges know it, else `map`."""
    heads = frames.select("frame_id", "header_ts_ns")
    world = "map" if edges.filter("parent = 'odom' or child = 'odom'").isEmpty() else "odom"
    own = motion(heads, edges, world, body).drop("tx", "ty", "tz")
    arm = lookup_at(heads, edges, body, cfg.imu_frame, "header_ts_ns").select("frame_id", "header_ts_ns", C("tx").alias("lx"), C("ty").alias("ly"), C("tz").alias("lz"))
    return own.join(arm, "frame_id").select("frame_id", *OF_FRAME)


def _in_sensor(f: Frame, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(velocity, gravity, lever arm) of a frame, all in the sensor's frame."""
    back = matrix_of(tuple(float(f[f"q{c}"][0]) for c in "xyzw")).T
    v, arm = (np.array([float(f[f"{n}{c}"][0]) for c in "xyz"]) for n in "vl")
    return back @ v, back @ np.array(UP_AXES[cfg.world_up_axis]), arm


def _path(f: Frame, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    v, gravity, arm = _in_sensor(f, cfg)
    return integrate(f["ts_ns"], np.stack([f["wx"], f["wy"], f["wz"]], 1), np.stack([f["ax"], f["ay"], f["az"]], 1), int(f["header_ts_ns"][0]), v, arm, gravity, cfg.gravity_sign)


def trajectories(frames: DataFrame, moves: DataFrame, samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(frame_id, pose) for frames of at least two samples in their window: a row per sample, in order of time. `moves`
    is what frame_motion() gives."""

    def kernel(f: Frame) -> Frame:
        if len(f["ts_ns"]) < 2:
            return {}
        q, x = _path(f, cfg)
        return {"ts_ns": f["ts_ns"], **{f"q{c}": q[:, k] for k, c in enumerate("xyzw")}, **{f"p{c}": x[:, k] for k, c in enumerate("xyz")}}

    met = window_join(frames.select("frame_id", "header_ts_ns"), samples.select("ts_ns", *SAMPLE)).drop("header_ts_ns").join(moves, "frame_id").select("frame_id", "ts_ns", *SAMPLE, *OF_FRAME)
    return per_frame(met, kernel, "frame_id bigint, " + TRAJECTORY, order="ts_ns")


def frame_samples(frames: DataFrame, moves: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples in the window of each frame (`inside`), with the frame's motion. A frame with fewer than two gets the
    nearest ones before and after its window too, from which a rate of turn at any of its points follows."""
    heads, own = frames.select("frame_id", "header_ts_ns"), samples.select("ts_ns", *SAMPLE)
    met = window_join(heads, own).select("frame_id", F.lit(True).alias("inside"), "ts_ns", *SAMPLE)
    enough = met.groupBy("frame_id").agg(F.count("*").alias("n")).filter("n >= 2").select("frame_id")
    ends = F.array(*(F.struct(F.lit(later).alias("later"), (C("header_ts_ns") + by).alias("at")) for later, by in ((False, -HALF_WINDOW - 1), (True, HALF_WINDOW + 1))))
    few = heads.join(enough, "frame_id", "left_anti").select("frame_id", F.explode(ends).alias("e")).select("frame_id", "e.later", "e.at")
    near = as_of(few, own, "at", list(SAMPLE))
    side = {c: F.when(C("later"), C(f"n_{c}")).otherwise(C(f"p_{c}")).alias(c) for c in ("ts_ns", *SAMPLE)}
    rest = near.select("frame_id", F.lit(False).alias("inside"), *side.values()).filter("ts_ns is not null")
    return met.unionByName(rest).join(moves.select("frame_id", *OF_FRAME), "frame_id")


def moved(xyz: np.ndarray, timestamp: np.ndarray, f: Frame, cfg: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(points at the frame's time, whether each was moved) by the frame's samples in order of time. Points that are not
    finite, or too far from the frame's time, stay. With two samples in the window or more the path's pose at the point's
    time, between the two around it, turns it about the lever arm; else velocity and rate of turn do."""
    target = int(f["header_ts_ns"][0])
    go = np.isfinite(xyz).all(1) & np.isfinite(timestamp)
    at = (np.where(go, timestamp, 0.0) * 1e9).astype(np.int64)
    dt = (at.astype(np.float64) - float(target)) / 1e9
    go &= np.abs(dt) <= TIME_GATE
    at, dt, p = at[go], dt[go], xyz[go]
    v, _, arm = _in_sensor(f, cfg)
    inside = {c: x[f["inside"]] for c, x in f.items()}
    ts = inside["ts_ns"] if inside["inside"].sum() >= 2 else f["ts_ns"]
    hi = np.minimum(np.searchsorted(ts, at, "left"), len(ts) - 1)
    lo = np.where(at > ts[-1], hi, np.maximum(hi - 1, 0))
    span = (ts[hi] - ts[lo]).astype(np.float64)
    a = np.clip(np.divide((at - ts[lo]).astype(np.float64), span, out=np.zeros(len(at)), where=span > 0), 0, 1)[:, None]
    if len(ts) == len(inside["ts_ns"]) and len(ts) >= 2:
        q, x = _path(inside, cfg)
        turn = (1 - a) * q[lo] + a * q[hi]
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        u, w = turn[:, :3], turn[:, 3:]
        rel = p - arm
        t = 2 * np.cross(u, rel)
        new = rel + w * t + np.cross(u, t) + arm + (1 - a) * x[lo] + a * x[hi]
    else:
        gyro = np.stack([f["wx"], f["wy"], f["wz"]], 1)
        turn = dt[:, None] * (((1 - a) * gyro[lo] + a * gyro[hi]) @ AXES.T)
        angle = np.linalg.norm(turn, axis=1)[:, None]
        axis = np.divide(turn, angle, out=np.zeros_like(turn), where=angle > 0)
        rel = p - arm
        round_ = rel * np.cos(angle) + np.cross(axis, rel) * np.sin(angle) + axis * (axis * rel).sum(1)[:, None] * (1 - np.cos(angle))
        new = np.where(angle > 1e-6, round_, rel) + arm + dt[:, None] * v
    out = xyz.copy()
    out[go] = new
    return out, go


def deskew_points(points: DataFrame, frames: DataFrame, moves: DataFrame, samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """points with x, y, z moved to their frame's time and a last column `moved`, the length of the move, null where a point
    stays. Points of frames without motion stay, and all do if there are no samples at all."""
    schema = StructType([*points.schema.fields, StructField("moved", DoubleType())])
    kinds = to_arrow_schema(schema)
    names = points.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n or not right.num_rows:
            return pa.table([*left.columns, pa.nulls(n, pa.float64())], [*names, "moved"]).cast(kinds)
        right = right.sort_by("ts_ns")
        column = lambda t, c: t.column(c).to_numpy().astype(np.float64)
        f = {c: right.column(c).to_numpy() for c in right.column_names}
        xyz = np.stack([column(left, c) for c in "xyz"], 1)
        new, go = moved(xyz, column(left, "timestamp"), f, cfg)
        gone = np.sqrt(((new - xyz) ** 2).sum(1))
        place = {c: pc.if_else(pa.array(go), pa.array(new[:, k]), left.column(c).cast(pa.float64())) for k, c in enumerate("xyz")}
        cols = [place.get(c, left.column(c)) for c in names]
        return pa.table([*cols, pa.array(gone, mask=~go)], [*names, "moved"]).cast(kinds)

    met = frame_samples(frames, moves, samples)
    return points.groupBy("frame_id").cogroup(met.groupBy("frame_id")).applyInArrow(run, schema)


def deskew_metrics(moved: DataFrame) -> DataFrame:
    return moved.groupBy("frame_id").agg(F.count("moved").alias("n"), F.avg("moved").alias("avg_m"), F.max("moved").alias("max_m"))

