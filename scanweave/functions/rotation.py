"""Quaternions (x, y, z, w), rotations and rigid transforms: as columns, and as numpy for the driver and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

V, Q = tuple[Column, Column, Column], tuple[Column, Column, Column, Column]


def rotate(q: Q, v: V) -> V:
    """v turned by the unit quaternion q: v + 2 w (u x v) + 2 u x (u x v)."""
    qx, qy, qz, qw = q
    x, y, z = v
    tx, ty, tz = 2.0 * (qy * z - qz * y), 2.0 * (qz * x - qx * z), 2.0 * (qx * y - qy * x)
    return x + qw * tx + (qy * tz - qz * ty), y + qw * ty + (qz * tx - qx * tz), z + qw * tz + (qx * ty - qy * tx)


def nlerp(a: Q, b: Q, t: Column) -> Q:
    """Normalised blend of two quaternions; their signs are taken as they are."""
    mixed = [(1.0 - t) * p + t * q for p, q in zip(a, b, strict=True)]
    n = F.sqrt(sum((m * m for m in mixed[1:]), mixed[0] * mixed[0]))
    return tuple(m / n for m in mixed)  # type: ignore[return-value]


def multiply(a: Q, b: Q) -> Q:
    """The rotation b, and after it a."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def inverse(q: Q) -> Q:
    return -q[0], -q[1], -q[2], q[3]


def slerp(a: Q, b: Q, t: Column) -> Q:
    """The rotation at the place t of the shorter arc from a to b, both of unit length."""
    dot = sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    bent = F.sin(angle) > 1e-9
    left = F.when(bent, F.try_divide(F.sin((1.0 - t) * angle), F.sin(angle))).otherwise(1.0 - t)
    right = F.when(bent, F.try_divide(F.sin(t * angle), F.sin(angle))).otherwise(t) * F.when(dot < 0, -1.0).otherwise(1.0)
    return tuple(left * p + right * q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def rodrigues(w: V, v: V, least: float = 1e-6) -> V:
    """v turned by the rotation vector w; unchanged if its angle is not above `least`."""
    angle = F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    k = [F.try_divide(c, angle) for c in w]
    c, s = F.cos(angle), F.sin(angle)
    dot = k[0] * v[0] + k[1] * v[1] + k[2] * v[2]
    cross = (k[1] * v[2] - k[2] * v[1], k[2] * v[0] - k[0] * v[2], k[0] * v[1] - k[1] * v[0])
    return tuple(F.when(angle > least, a * c + x * s + kk * dot * (1.0 - c)).otherwise(a) for a, x, kk in zip(v, cross, k, strict=True))  # type: ignore[return-value]


def euler_matrix(roll_deg: float, pitch_deg: float, yaw_deg: float) -> np.ndarray:
    """Yaw after pitch after roll."""
    r, p, y = (math.radians(a) for a in (roll_deg, pitch_deg, yaw_deg))
    rx = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    ry = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
    rz = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
    return rz @ ry @ rx


def extrinsic(rotation: tuple[float, ...], translation: tuple[float, ...], roll_deg: float, pitch_deg: float, yaw_deg: float) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation): the base rotation (row by row) with the correction behind it. Lists of another length
    than 9 and 3 stand for the identity."""
    base = np.array(rotation, float).reshape(3, 3) if len(rotation) == 9 else np.eye(3)
    return base @ euler_matrix(roll_deg, pitch_deg, yaw_deg), np.array(translation, float) if len(translation) == 3 else np.zeros(3)


def matrix_of(q: tuple[float, float, float, float]) -> np.ndarray:
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def quaternion_of(m: np.ndarray) -> tuple[float, float, float, float]:
    """Unit quaternion of a rotation matrix, with w >= 0 where it is the largest part."""
    t = np.trace(m)
    if t > 0:
        s = 2 * math.sqrt(t + 1)
        return (m[2, 1] - m[1, 2]) / s, (m[0, 2] - m[2, 0]) / s, (m[1, 0] - m[0, 1]) / s, s / 4
    i = int(np.argmax(np.diag(m)))
    j, k = (i + 1) % 3, (i + 2) % 3
    s = 2 * math.sqrt(1 + m[i, i] - m[j, j] - m[k, k])
    q = [0.0] * 4
    q[i], q[j], q[k], q[3] = s / 4, (m[j, i] + m[i, j]) / s, (m[k, i] + m[i, k]) / s, (m[k, j] - m[j, k]) / s
    return tuple(q)  # type: ignore[return-value]
