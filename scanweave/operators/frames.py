"""Running a kernel over whole frames, and the graph steps that kernels share.

Frames are independent and small, so a kernel sees one frame at a time. Rows are grouped by frame: where they are dealt
by frame already, nothing is shuffled again. A task holds one frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Frame = dict[str, np.ndarray]


def per_frame(df: DataFrame, kernel: Callable[[Frame], Frame], schema: str, order: str = "point_idx", frame: str = "frame_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """kernel(columns of a frame, in order) -> columns of its result rows; the frame's id need not be among them. Columns
    of `keep`, numbers, go with the rows of the result that have their `order` value, so no join has to bring them."""
    schema += "".join(f", {c} double" for c in keep)
    names = [c.split()[0] for c in schema.split(",")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        got = kernel({n: t.column(n).to_numpy() for n in t.column_names})
        n = len(next(iter(got.values()))) if got else 0
        if keep:
            at = np.searchsorted(t.column(order).to_numpy(), got[order])
            got = {c: t.column(c).to_numpy()[at] for c in keep} | got
        if not got:
            got = {c: np.zeros(0) for c in names}
        got = {frame: np.full(n, t.column(frame)[0].as_py()), **got}
        return pa.table([pa.array(got[c], from_pandas=True) for c in names], names).cast(kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return df.groupBy(frame).applyInArrow(run, schema)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cell_ids(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each row, sorted distinct keys, span): whole-number cells as one key, with a rim so that neighbours differ
    by a fixed number."""
    low = cells.min(0) - 1
    span = cells.max(0) - low + 2
    weight = np.append(np.cumprod(span[::-1])[::-1][1:], 1)
    return ((cells - low) * weight).sum(1), weight, span


def half_offsets(dim: int) -> np.ndarray:
    """One of each pair of opposite neighbour offsets."""
    grid = np.stack(np.meshgrid(*[[-1, 0, 1]] * dim, indexing="ij"), -1).reshape(-1, dim)
    return grid[len(grid) // 2 + 1 :]


Nearest = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _squared(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return x * x + y * y + z * z


def _ranked(i: np.ndarray, j: np.ndarray, d2: np.ndarray, k: int) -> Nearest:
    """The first k of each i by (d2, j)."""
    by = np.lexsort((j, d2, i))
    i, j, d2 = i[by], j[by], d2[by]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    use = rank < k
    return i[use], j[use], rank[use], d2[use]


def _nearest_of_all(xyz: np.ndarray, asked: np.ndarray, k: int) -> Nearest:
    """Against every row; rows that are not finite come last."""
    with np.errstate(invalid="ignore"):
        d2 = _squared(*(c[asked][:, None] - c for c in xyz.T))
        d2[np.arange(len(asked)), asked] = -1.0
        at = min(k, len(xyz)) - 1
        row, j = np.nonzero(~(d2 > np.partition(d2, at, 1)[:, at : at + 1]))
    return _ranked(asked[row], j, d2[row, j], k)


def nearest_within(xyz: np.ndarray, k: int, reach: float, most: int = 1 << 20) -> Nearest:
    """(i, j, rank, d2) of the k nearest rows of each, itself at rank 0 with d2 -1, then by (d2, j). Candidates come from
    cells of size `reach`, doubled for rows that have fewer than k within it, and from all rows where those are few or the
    cells as large as the frame. About `most` candidates are held at a time, or those of one row."""
    n, found = len(xyz), []
    if not n:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))
    with np.errstate(invalid="ignore"):
        extent = float((xyz.max(0) - xyz.min(0)).max())
    reach = max(reach, extent / 2**19)  # keys of cells fit 64 bits
    left = np.arange(n)
    while len(left) * n > most and extent > 2 * reach and np.isfinite(extent):
        key, weight, _ = cell_ids(np.floor((xyz - xyz.min(0)) / reach).astype(np.int64))
        order = np.argsort(key, kind="stable")
        sides = half_offsets(xyz.shape[1])
        want = key[left] + (np.concatenate([-sides, 0 * sides[:1], sides]) @ weight)[:, None]
        at = np.searchsorted(key[order], want)
        count = np.searchsorted(key[order], want, "right") - at
        total, again = np.cumsum(count.sum(0)), []
        for part in np.split(np.arange(len(left)), np.unique(np.searchsorted(total, np.arange(most, total[-1], most)))):
            per = count[:, part].T.ravel()
            i = np.repeat(np.repeat(left[part], len(at)), per)
            j = order[np.arange(per.sum()) + np.repeat(at[:, part].T.ravel() - np.cumsum(per) + per, per)]
            d2 = np.where(i == j, -1.0, _squared(*(xyz[i] - xyz[j]).T))
            near = d2 <= reach * reach
            enough = np.bincount(i[near], minlength=n) >= min(k, n)
            use = near & enough[i]
            found.append(_ranked(i[use], j[use], d2[use], k))
            again.append(left[part][~enough[left[part]]])
        left, reach = np.concatenate(again), 2 * reach
    found += [_nearest_of_all(xyz, left[s : s + max(1, most // n)], k) for s in range(0, len(left), max(1, most // n))]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def pairs_within(xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with a distance of at most radius, by cells of that size."""
    if len(xyz) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, weight, _ = cell_ids(np.floor(xyz / radius).astype(np.int64))
    order = np.argsort(key, kind="stable")
    keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
    out_a, out_b = [], []
    for off in [np.zeros(xyz.shape[1], np.int64), *half_offsets(xyz.shape[1])]:
        want = keys + (off * weight).sum()
        at = np.searchsorted(keys, want)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want))
        left, right = hit, at[hit]
        n = count[left] * count[right]
        which = np.repeat(np.arange(len(left)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = order[first[left][which] + inner // count[right][which]]
        j = order[first[right][which] + inner % count[right][which]]
        near = ((xyz[i] - xyz[j]) ** 2).sum(1) <= radius * radius
        if not off.any():
            near &= i < j
        out_a.append(np.minimum(i, j)[near])
        out_b.append(np.maximum(i, j)[near])
    return np.concatenate(out_a), np.concatenate(out_b)
