"""Six interchangeable clusterers: obstacle points in, (frame_id, point_idx, cluster_id) out.

cluster_id counts from 0 in each frame, in the order the method names its clusters. Points of no cluster, or of one
outside the size limits, have no row. Components are found by a kernel per frame; the neighbour tables they walk over
are also operators of their own (joins.py).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..config import COLUMNS, DEFAULT, RINGS, Config
from ..functions.scalars import RING_STEPS
from .frames import Frame, cell_ids, connected, half_offsets, pairs_within, per_frame

LABELS = "frame_id bigint, point_idx bigint, cluster_id int"


def _run(points: DataFrame, names: tuple[str, ...], kernel: Callable[[Frame], Frame], keep: tuple[str, ...]) -> DataFrame:
    return per_frame(points.select(*dict.fromkeys((*names, *keep))), kernel, LABELS, keep=keep)


def numbered(point_idx: np.ndarray, label: np.ndarray, low: int, high: int, rank: dict[int, tuple] | None = None) -> Frame:
    """Rows of the labels whose size is within limits, numbered by first point or by the given rank; -1 is none."""
    kept = label >= 0
    names, first, code, size = np.unique(label[kept], return_index=True, return_inverse=True, return_counts=True)
    at = np.flatnonzero(kept)
    order = sorted((k for k in range(len(names)) if low <= size[k] <= high), key=lambda k: rank[int(names[k])] if rank else point_idx[at[first[k]]])
    number = np.full(len(names), -1)
    number[order] = np.arange(len(order))
    got = number[code]
    return {"point_idx": point_idx[at][got >= 0], "cluster_id": got[got >= 0].astype(np.int32)}


def _xyz(f: Frame) -> np.ndarray:
    return np.stack([f["x"], f["y"], f["z"]], 1)


def _by_cells(f: Frame, cells: np.ndarray, inside: np.ndarray, low: int, high: int) -> Frame:
    """Components of touching occupied cells."""
    label = np.full(len(cells), -1)
    if inside.any():
        key, weight, _ = cell_ids(cells[inside])
        keys, first, code = np.unique(key, return_index=True, return_inverse=True)
        a, b = [], []
        for off in half_offsets(cells.shape[1]):
            want = keys + (off * weight).sum()
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == want)
            a.append(hit)
            b.append(at[hit])
        label[inside] = connected(len(keys), np.concatenate(a), np.concatenate(b))[code]
    return numbered(f["point_idx"], label, low, high)


def cluster_grid(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """8-connected occupied cells of the plane."""

    def kernel(f: Frame) -> Frame:
        xy = np.stack([f["x"], f["y"]], 1)
        inside = (np.abs(xy) <= cfg.max_range).all(1)
        return _by_cells(f, np.floor(xy / cfg.grid_resolution).astype(np.int64), inside, cfg.min_cluster_size, cfg.max_cluster_size)

    return _run(points, ("frame_id", "point_idx", "x", "y"), kernel, keep)


def cluster_voxel(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """26-connected occupied voxels."""

    def kernel(f: Frame) -> Frame:
        xyz = _xyz(f)
        return _by_cells(f, np.floor(xyz / cfg.voxel_grid_size).astype(np.int64), np.ones(len(xyz), bool), cfg.min_cluster_size, cfg.max_cluster_size)

    return _run(points, ("frame_id", "point_idx", "x", "y", "z"), kernel, keep)


XY_BOUND, Z_BOUND = 30.0, 2.0


def dbscan_cells(xyz: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(truncated cells, whether each point is in the grid)."""
    bound = np.array([XY_BOUND, XY_BOUND, Z_BOUND])
    cells = np.trunc((xyz + bound) / eps).astype(np.int64)
    return cells, ((cells >= 0) & (cells <= np.trunc(2 * bound / eps))).all(1)


def cluster_dbscan(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Density clusters; a point counts among its neighbours. A border point belongs to the first cluster that reaches
    it, so to the least one among its core neighbours. Points outside the grid are no one's neighbour, but can seed."""

    def kernel(f: Frame) -> Frame:
        xyz = _xyz(f)
        n, least = len(xyz), cfg.dbscan_min_pts
        _, inside = dbscan_cells(xyz, cfg.dbscan_eps)
        a, b = pairs_within(xyz, cfg.dbscan_eps)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        seen = inside[dst]
        src, dst = src[seen], dst[seen]
        degree = np.bincount(src, minlength=n) + inside
        core = degree >= least
        if inside.all():
            both = core[src] & core[dst]
            root = connected(n, src[both], dst[both])
            label = np.where(core, root, n)
            reach = core[src] & ~core[dst]
            np.minimum.at(label, dst[reach], root[src[reach]])
            label = np.where(label == n, -1, label)
            return numbered(f["point_idx"], label, cfg.min_cluster_size, cfg.max_cluster_size, {int(k): (k,) for k in np.unique(label)})
        order = np.argsort(src, kind="stable")
        at = np.searchsorted(src[order], np.arange(n + 1))
        near = dst[order]
        label = np.full(n, -1)
        for i in range(n):  # in scan order, each cluster to its end
            if label[i] != -1 or not core[i]:
                continue
            label[i], todo = i, deque([i])
            while todo:
                k = todo.popleft()
                if core[k]:
                    for j in near[at[k] : at[k + 1]]:
                        if label[j] < 0:
                            label[j] = i
                            todo.append(j)
        return numbered(f["point_idx"], label, cfg.min_cluster_size, cfg.max_cluster_size, {int(k): (k,) for k in np.unique(label)})

    return _run(points, ("frame_id", "point_idx", "x", "y", "z"), kernel, keep)


#: Frames above so many points are clustered by the centroids of voxels of this size.
MANY, COARSE = 5000, 0.04


def cluster_euclidean(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Components of points within the tolerance, largest first. In a frame of more than MANY points the members are
    voxel centroids: x, y, z are theirs, and point_idx is that of the voxel's first point."""

    def kernel(f: Frame) -> Frame:
        xyz, idx = _xyz(f), f["point_idx"]
        if len(xyz) > MANY:
            key, _, _ = cell_ids(np.floor(xyz / COARSE).astype(np.int64))
            _, first, code, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            xyz = np.stack([np.bincount(code, xyz[:, k]) / size for k in range(3)], 1)
            order = np.argsort(first)
            xyz, idx = xyz[order], idx[first[order]]
        label = connected(len(xyz), *pairs_within(xyz, cfg.euclidean_tolerance))
        names, size = np.unique(label, return_counts=True)
        got = numbered(idx, label, cfg.min_cluster_size, cfg.max_cluster_size, {int(k): (-int(s), k) for k, s in zip(names, size, strict=True)})
        at = np.searchsorted(idx, got["point_idx"])
        return got | {"x": xyz[at, 0], "y": xyz[at, 1], "z": xyz[at, 2]}

    return _run(points, ("frame_id", "point_idx", "x", "y", "z"), kernel, tuple(dict.fromkeys((*keep, "x", "y", "z"))))


def ring_steps() -> np.ndarray:
    out = np.full(RINGS, 6.0)
    for lo, hi, d in reversed(RING_STEPS):
        out[lo : hi + 1] = d
    return out * np.pi / 180.0


def cluster_depth(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Regions grown over the range image from seeds in row order. The step angle is that of the ring one comes from, so
    reaching is directed and a region depends on where it starts."""
    step, wide, limit = ring_steps(), 2 * np.pi / COLUMNS, np.radians(cfg.depth_theta_thr)
    window = [(r, c) for r in range(-2, 3) for c in range(-2, 3) if r or c]

    def kernel(f: Frame) -> Frame:
        xyz, ring = _xyz(f), f["ring"].astype(np.int64)
        dist = np.sqrt((xyz**2).sum(1))
        col = np.trunc((np.arctan2(xyz[:, 1], xyz[:, 0]) + np.pi) / (2 * np.pi) * COLUMNS).astype(np.int64) % COLUMNS
        ok = np.flatnonzero((ring >= 0) & (ring < RINGS))
        ok = ok[np.lexsort((ok, dist[ok], col[ok], ring[ok]))]
        key, first = np.unique(ring[ok] * COLUMNS + col[ok], return_index=True)
        pixel, depth = ok[first], dist[ok[first]]  # nearest return of each pixel, in row order
        place = np.full(RINGS * COLUMNS, -1)
        place[key] = np.arange(len(key))
        src, dst = [], []
        r, c = np.divmod(key, COLUMNS)
        for dr, dc in window:
            inside = (r + dr >= 0) & (r + dr < RINGS)
            to = np.where(inside, place[np.where(inside, (r + dr) * COLUMNS + (c + dc) % COLUMNS, 0)], -1)
            at = np.flatnonzero(to >= 0)
            to = to[at]
            alpha = abs(dr) * step[r[at]] if dr else np.full(len(at), abs(dc) * wide)
            near, far = np.minimum(depth[at], depth[to]), np.maximum(depth[at], depth[to])
            go = np.arctan2(near * np.sin(alpha), far - near * np.cos(alpha)) > limit
            src.append(at[go])
            dst.append(to[go])
        src, dst = np.concatenate(src), np.concatenate(dst)
        order = np.argsort(src, kind="stable")
        to, ends = dst[order], np.searchsorted(src[order], np.arange(len(key) + 1))
        own = np.full(len(key), -1)
        for seed in range(len(key)):
            if own[seed] >= 0:
                continue
            own[seed], front = seed, np.array([seed])
            while len(front):  # one step of the whole region's rim at a time
                n = ends[front + 1] - ends[front]
                reached = to[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[front], n)]
                front = np.unique(reached[own[reached] < 0])
                own[front] = seed
        label = np.full(len(xyz), -1)
        label[pixel] = pixel[own]
        rank = {int(s): (ring[s] * COLUMNS + col[s],) for s in np.unique(label) if s >= 0}
        return numbered(f["point_idx"], label, cfg.min_cluster_size, cfg.max_cluster_size, rank)

    return _run(points, ("frame_id", "point_idx", "x", "y", "z", "ring"), kernel, keep)


NEIGHBOURS, NO_CORE = 8, 2.0


def nearest(xyz: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances) of the k nearest points of each, itself first; ties by index. Points that have k others within
    a small radius are done by cells of that size; the radius doubles for the rest, and the last few meet all points."""
    n, k = len(xyz), min(k, len(xyz))
    idx, dist = np.zeros((n, k), np.int64), np.zeros((n, k))
    left, radius = np.arange(n), 0.1
    while len(left) * n > 1 << 22 and radius < 4:
        a, b = pairs_within(xyz, radius)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        wanted = np.zeros(n, bool)
        wanted[left] = True
        src, dst = src[wanted[src]], dst[wanted[src]]
        d = ((xyz[src] - xyz[dst]) ** 2).sum(1)
        order = np.lexsort((dst, d, src))
        src, dst, d = src[order], dst[order], d[order]
        first, count = np.searchsorted(src, left), np.bincount(src, minlength=n)[left]
        full = count >= k - 1
        at = first[full][:, None] + np.arange(k - 1)
        done = left[full]
        idx[done, 0], idx[done, 1:], dist[done, 1:] = done, dst[at], np.sqrt(d[at])
        left, radius = left[~full], radius * 2
    rows = max(1, (1 << 22) // max(n, 1))
    for lo in range(0, len(left), rows):
        own = left[lo : lo + rows]
        d = ((xyz[own, None] - xyz[None]) ** 2).sum(2)
        d[np.arange(len(d)), own] = -1.0
        o = np.argsort(d, axis=1, kind="stable")[:, :k]
        idx[own], dist[own] = o, np.sqrt(np.maximum(np.take_along_axis(d, o, 1), 0))
    return idx, dist


def reach_edges(xyz: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, weight) of the mutual-reachability edges, u < v as found from u."""
    scale = 1 + cfg.hdbscan_alpha * np.sqrt((xyz[:, :2] ** 2).sum(1))
    idx, d = nearest(xyz, max(cfg.hdbscan_min_pts, NEIGHBOURS))
    core = d[:, cfg.hdbscan_min_pts - 1] / scale if d.shape[1] >= cfg.hdbscan_min_pts else np.full(len(xyz), NO_CORE)
    idx, d = idx[:, :NEIGHBOURS], d[:, :NEIGHBOURS]
    u, v = np.repeat(np.arange(len(xyz)), idx.shape[1] - 1), idx[:, 1:].ravel()
    w = np.maximum(np.maximum(core[u], core[v]), d[:, 1:].ravel() / scale[u])
    own = u < v
    return u[own], v[own], w[own]


def cluster_hdbscan(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = (), most: int = 300) -> DataFrame:
    """Components of the lightest edges, joined while together they have at most `most` points; no distance limit."""

    def kernel(f: Frame) -> Frame:
        xyz = _xyz(f)
        u, v, w = reach_edges(xyz, cfg)
        root, size = list(range(len(xyz))), [1] * len(xyz)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k in np.lexsort((v, u, w)).tolist():
            i, j = find(int(u[k])), find(int(v[k]))
            if i != j and size[i] + size[j] <= most:
                root[i] = j
                size[j] += size[i]
        label = np.array([find(i) for i in range(len(xyz))], np.int64)
        return numbered(f["point_idx"], label, cfg.min_cluster_size, most)

    return _run(points, ("frame_id", "point_idx", "x", "y", "z"), kernel, keep)


CLUSTERERS = {"grid": cluster_grid, "voxel": cluster_voxel, "dbscan": cluster_dbscan, "euclidean": cluster_euclidean, "depth": cluster_depth, "hdbscan": cluster_hdbscan}


def cluster(points: DataFrame, cfg: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """By the configured method, with columns to keep; an unknown name is an error."""
    if cfg.clustering_algorithm not in CLUSTERERS:
        raise ValueError(f"unknown clusterer {cfg.clustering_algorithm!r}; known: {sorted(CLUSTERERS)}")
    return CLUSTERERS[cfg.clustering_algorithm](points, cfg, keep)
