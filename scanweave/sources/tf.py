"""Rigid transforms between named frames: the static ones, moving edges, and paths through the tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.rotation import extrinsic, inverse, matrix_of, multiply, quaternion_of, rotate, slerp
from ..operators.temporal import as_of, share
from ..schema import TF


def static_transforms(spark: SparkSession, cfg: Config = DEFAULT.override(roll_deg=0.0), ts_ns: int = 0) -> DataFrame:
    """The four fixed edges between sensor and camera frames, in the schema of `tf`."""
    m, t = extrinsic(cfg.extrinsic_rotation, cfg.extrinsic_translation, cfg.roll_deg, cfg.pitch_deg, cfg.yaw_deg)
    one = (0.0, 0.0, 0.0, 1.0)
    rows = [
        ("lidar", "camera_optical", ts_ns, *map(float, t), *map(float, quaternion_of(m)), True),
        ("camera_link", "camera_center", ts_ns, 0.0, 0.0, 0.015, *one, True),
        ("camera_center", "camera_left", ts_ns, -0.01, 0.05995845, 0.0, *one, True),
        ("camera_left", "camera_left_optical", ts_ns, 0.0, 0.0, 0.0, 0.5, -0.5, 0.5, -0.5, True),
    ]
    return spark.createDataFrame(rows, TF)


def moving_transforms(poses: DataFrame, parent: str, child: str) -> DataFrame:
    """An edge over time from poses, in the schema of `tf`; poses without qx, qy, qz, qw have no rotation."""
    turn = [F.col(c) if c in poses.columns else F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))]
    return poses.select(F.lit(parent).alias("parent"), F.lit(child).alias("child"), "ts_ns", "tx", "ty", "tz", *turn, F.lit(False).alias("is_static"))


def chain(pairs: list[tuple[str, str]], target: str, source: str) -> list[tuple[str, str, bool]] | None:
    """(parent, child, whether it goes from parent to child) of the edges from target to source; None without a path."""
    todo: list[tuple[str, list]] = [(target, [])]
    seen = {target}
    for at, steps in todo:  # grows as it goes
        if at == source:
            return steps
        for a, b in sorted(pairs):
            for here, to, forward in ((a, b, True), (b, a, False)):
                if here == at and to not in seen:
                    seen.add(to)
                    todo.append((to, [*steps, (a, b, forward)]))
    return None


def _matrix(e) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = matrix_of((e["qx"], e["qy"], e["qz"], e["qw"])), (e["tx"], e["ty"], e["tz"])
    return m


def _slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    dot = float(a @ b)
    angle = np.arccos(min(1.0, abs(dot)))
    left, right = (np.sin((1 - t) * angle) / np.sin(angle), np.sin(t * angle) / np.sin(angle)) if np.sin(angle) > 1e-9 else (1 - t, t)
    return left * a + right * b * (-1 if dot < 0 else 1)


def _latest(edges: DataFrame, steps: list[tuple[str, str, bool]], moving: list[tuple[str, str]], fixed: dict) -> np.ndarray | None:
    """The chain's transform at the last time that all its moving edges have; None if one has no row. Two rows of each
    edge come to the driver."""
    of = lambda pair: edges.filter((F.col("parent") == pair[0]) & (F.col("child") == pair[1]) & ~F.col("is_static"))
    ends = [of(pair).agg(F.max("ts_ns").alias("t")).first()["t"] for pair in moving]
    if any(t is None for t in ends):
        return None
    at = min(ends)
    known = dict(fixed)
    for pair in moving:
        row = F.struct("ts_ns", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
        got = of(pair).agg(F.max(F.when(F.col("ts_ns") <= at, row)).alias("p"), F.min(F.when(F.col("ts_ns") >= at, row)).alias("n")).first()
        p, n = got["p"] or got["n"], got["n"]
        a = (at - p["ts_ns"]) / (n["ts_ns"] - p["ts_ns"]) if n["ts_ns"] > p["ts_ns"] else 0.0
        t = [(1 - a) * p[c] + a * n[c] for c in ("tx", "ty", "tz")]
        q = _slerp(*(np.array([r[c] for c in ("qx", "qy", "qz", "qw")]) for r in (p, n)), a)
        known[pair] = _matrix(dict(zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), [*t, *q], strict=True)))
    m = np.eye(4)
    for a, b, forward in steps:
        m = m @ (known[a, b] if forward else np.linalg.inv(known[a, b]))
    return m


def lookup_at(rows: DataFrame, edges: DataFrame, target: str, source: str, at: str) -> DataFrame:
    """rows with tx ... qw, the transform from source to target at the time `at`: moving edges are interpolated, position by
    line and rotation by arc, static ones hold at any time. Where a moving edge does not reach, the latest transform that
    the chain has stands for it, and the identity where there is no path. The tree has a few edges; its names and static
    rows come to the driver, the moving rows are joined by time."""
    names = edges.groupBy("parent", "child", "is_static").agg(F.max(F.struct("ts_ns", "tx", "ty", "tz", "qx", "qy", "qz", "qw")).alias("last")).collect()
    fixed = {(r["parent"], r["child"]): _matrix(r["last"]) for r in names if r["is_static"]}
    moving = {(r["parent"], r["child"]) for r in names if not r["is_static"]} - set(fixed)
    steps = chain([*fixed, *moving], target, source)
    lits = lambda m: ([F.lit(float(v)) for v in m[:3, 3]], [F.lit(float(v)) for v in quaternion_of(m[:3, :3])])
    own = rows.columns
    out = lambda df, t, q: df.select(*own, *(c.alias(n) for c, n in zip((*t, *q), ("tx", "ty", "tz", "qx", "qy", "qz", "qw"), strict=True)))
    used = [(a, b) for a, b, _ in steps or () if (a, b) in moving]
    last = _latest(edges, steps, used, fixed) if used else None
    if steps is None or used and last is None:
        return out(rows, *lits(np.eye(4)))
    t, q, whole = *lits(np.eye(4)), F.lit(True)
    for k, (a, b, forward) in enumerate(steps):
        if (a, b) in moving:
            of = edges.filter((F.col("parent") == a) & (F.col("child") == b) & ~F.col("is_static")).select("ts_ns", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
            near = as_of(rows, of, at, ["tx", "ty", "tz", "qx", "qy", "qz", "qw"])
            place = share(F.col(at))
            found = F.col("p_ts_ns").isNotNull() & F.col("n_ts_ns").isNotNull()
            st = [(1.0 - place) * F.col(f"p_{c}") + place * F.col(f"n_{c}") for c in ("tx", "ty", "tz")]
            sq = slerp(tuple(F.col(f"p_q{c}") for c in "xyzw"), tuple(F.col(f"n_q{c}") for c in "xyzw"), place)
            step = [c.alias(f"__{n}{k}") for c, n in zip((*st, *sq, found), ("tx", "ty", "tz", "qx", "qy", "qz", "qw", "in"), strict=True)]
            rows = near.select(*rows.columns, *step)
            st, sq = [F.col(f"__t{c}{k}") for c in "xyz"], tuple(F.col(f"__q{c}{k}") for c in "xyzw")
            whole = whole & F.col(f"__in{k}")
        else:
            st, sq = lits(fixed[a, b])
        if not forward:
            sq = inverse(tuple(sq))
            st = [-c for c in rotate(sq, tuple(st))]
        t, q = [x + y for x, y in zip(t, rotate(tuple(q), tuple(st)), strict=True)], multiply(tuple(q), tuple(sq))
    if used:
        lt, lq = lits(last)
        t, q = [F.when(whole, x).otherwise(y) for x, y in zip(t, lt, strict=True)], [F.when(whole, x).otherwise(y) for x, y in zip(q, lq, strict=True)]
    return out(rows, t, q)


def lookup(edges: list, target: str, source: str) -> np.ndarray:
    """4 x 4 transform from source to target through the edges; the identity if there is no path."""
    near: dict[str, list[tuple[str, np.ndarray]]] = {}
    for e in edges:
        m = _matrix(e)
        near.setdefault(e["parent"], []).append((e["child"], m))
        near.setdefault(e["child"], []).append((e["parent"], np.linalg.inv(m)))
    todo, seen = [(target, np.eye(4))], {target}
    while todo:
        at, m = todo.pop(0)
        if at == source:
            return m
        for to, step in near.get(at, ()):
            if to not in seen:
                seen.add(to)
                todo.append((to, m @ step))
    return np.eye(4)
