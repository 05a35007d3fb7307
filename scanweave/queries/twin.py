"""Building blocks of the SQL twins: named CTEs, put together in order."""

from __future__ import annotations

from ..sources import fixtures as fx

SECTOR = lambda seg: f"(cast(floor((case when atan2(y, x) < 0 then atan2(y, x) * 180e0 / 3.141592653589793e0 + 360e0 else atan2(y, x) * 180e0 / 3.141592653589793e0 end) / (360e0 / {seg})) as int) % {seg})"
BIN = "least(499, cast(floor(sqrt(x * x + y * y) / (25e0 / 500)) as int))"
COLUMN = "(cast(floor((atan2(y, x) + 3.141592653589793e0) / (2e0 * 3.141592653589793e0) * 2048) as int) % 2048)"

CTE = {
    "points": fx.POINTS,
    "wide": fx.WIDE_POINTS,
    "imu": fx.IMU,
    "poses": fx.POSES,
    "frames": fx.FRAMES,
    "profiles": fx.PROFILES,
    "log": fx.CLUSTER_LOG,
    # points of the pipeline, truncated and normalised
    "kept": "select * from points where x * x + y * y between 0.0625e0 and 625e0 and isfinite(x) and isfinite(y) and isfinite(z)",
    "norm": "select frame_id, point_idx, ring, x, y, z, case when x * x + y * y + z * z > 1 then least(255e0, intensity * greatest(1e0, (x * x + y * y + z * z) / 100e0)) else intensity end as intensity from kept",
    "polar": f"select *, {SECTOR(500)} as seg, {BIN} as bin from norm where sqrt(x * x + y * y) between 0.5e0 and 25e0",
    "celled": "select *, min(z) over (partition by frame_id, seg, bin) as cell_min_z from polar",
    "obs": "select frame_id, point_idx, ring, x, y, z, intensity from celled where z >= -0.47e0 and z > cell_min_z + 0.02e0",
    # components of touching cells: each cell's least anchor
    "cells": "select frame_id, cast(floor(x / 0.12e0) as int) as cx, cast(floor(y / 0.12e0) as int) as cy, min(point_idx) as idx from obs where abs(x) <= 25 and abs(y) <= 25 group by all",
    "cell_edges": "select a.frame_id, a.idx as a, b.idx as b from cells a join cells b on a.frame_id = b.frame_id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1",
    "walk": "select frame_id, idx as node, idx as label from cells union select e.frame_id, e.b, w.label from walk w join cell_edges e on e.frame_id = w.frame_id and e.a = w.node",
    "roots": "select frame_id, node, min(label) as root from walk group by all",
    "member0": "select o.*, r.root from obs o join cells c on c.frame_id = o.frame_id and c.cx = cast(floor(o.x / 0.12e0) as int) and c.cy = cast(floor(o.y / 0.12e0) as int) join roots r on r.frame_id = c.frame_id and r.node = c.idx",
    "sized": "select *, count(*) over (partition by frame_id, root) as n from member0",
    "members": "select frame_id, point_idx, x, y, z, intensity, cast(dense_rank() over (partition by frame_id order by root) - 1 as int) as cluster_id from sized where n between 2 and 300",
    # greedy merging
    "cent": "select frame_id, cluster_id, count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz from members group by all",
    "ord": "select *, row_number() over (partition by frame_id order by cluster_id) as k from cent",
    "fold": """select frame_id, k, [struct_pack(id := cluster_id, x := cx, y := cy)] as seeds from ord where k = 1 union all
      select o.frame_id, o.k, case when len(list_filter(f.seeds, lambda s: (s.x - o.cx) * (s.x - o.cx) + (s.y - o.cy) * (s.y - o.cy) < 0.25e0 * 0.25e0)) > 0 then f.seeds
        else list_append(f.seeds, struct_pack(id := o.cluster_id, x := o.cx, y := o.cy)) end from fold f join ord o on o.frame_id = f.frame_id and o.k = f.k + 1""",
    "seeds": "select frame_id, unnest(arg_max(seeds, k)) as s from fold group by frame_id",
    "seeded": "select o.frame_id, o.cluster_id, min(s.id) as seed_id from ord o join seeds using (frame_id) where (s.x - o.cx) * (s.x - o.cx) + (s.y - o.cy) * (s.y - o.cy) < 0.25e0 * 0.25e0 group by all",
    "merged": "select m.* replace (s.seed_id as cluster_id) from members m join seeded s using (frame_id, cluster_id)",
    # shape
    "mom": """select frame_id, cluster_id, count(*) as point_count, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z, avg(x) as x, avg(y) as y, avg(z) as mean_z,
      avg(intensity) as avg_intensity, covar_pop(x, x) as cxx, covar_pop(y, y) as cyy, covar_pop(z, z) as czz, covar_pop(x, y) as cxy, covar_pop(x, z) as cxz, covar_pop(y, z) as cyz from merged group by all""",
    "shape": """select *, min_z as z, sqrt(x * x + y * y) as range, atan2(y, x) as bearing, max_z - min_z as height, greatest(max_x - min_x, max_y - min_y) as width_max,
      greatest(0.001e0, least(max_x - min_x, max_y - min_y)) as width_min, (cxx + cyy + czz) / 3e0 as q from mom""",
    "eig0": "select *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2e0 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6e0) as p, (cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz) as det from shape",
    "eig1": "select *, case when p > 0 then acos(greatest(-1e0, least(1e0, det / (2e0 * p * p * p)))) else 0e0 end / 3e0 as phi from eig0",
    "eig2": "select *, q + 2e0 * p * cos(phi) as l1, q + 2e0 * p * cos(phi + 2e0 * 3.141592653589793e0 / 3e0) as l3 from eig1",
    "eig": "select *, cxx + cyy + czz - l1 - l3 as l2 from eig2",
    "feat": """select frame_id, cluster_id, point_count, x, y, z, range, bearing, height, width_max, width_min, case when height > 0.001e0 then width_max / height else 0e0 end as aspect_ratio, avg_intensity,
      case when l1 + l2 + l3 > 1e-6 then (l1 - l2) / l1 else 0e0 end as linearity, case when l1 + l2 + l3 > 1e-6 then (l2 - l3) / l1 else 0e0 end as planarity, case when l1 + l2 + l3 > 1e-6 then l3 / l1 else 0e0 end as scattering,
      sqrt(greatest(0e0, least(1e0, case when (l1 - l2) * (l1 - l3) <> 0 then (l1 * l1 - l1 * (cxx + cyy) + cxx * cyy - cxy * cxy) / ((l1 - l2) * (l1 - l3)) else 0e0 end))) as verticality, width_max / width_min as symmetry from eig""",
    "expected": "select *, least(60, greatest(3, cast(floor(least(60e0, case when range > 0 then 500e0 / (range * range) else 60e0 end)) as int))) as expected_n from feat",
    "ruled": """select *, case when point_count < 2 then 'NONE' when height < 0.1e0 * 0.8e0 or height > 0.8e0 * 1.2e0 or width_max > 0.5e0 * 1.5e0 then 'EARLY_AABB'
      when point_count / expected_n::double < 0.85e0 and not (verticality > 0.85e0 and symmetry < 1.5e0) then 'POINT_COUNT' when avg_intensity < 5 then 'LOW_INTENSITY' when linearity > 0.88e0 then 'PCA_LINEARITY'
      when planarity > 0.8e0 + 0.1e0 then 'PCA_PLANARITY' when scattering < 0.02e0 * 0.3e0 then 'PCA_SCATTER' when verticality < 0.65e0 then 'VERTICALITY' when height < 0.1e0 or height > 0.8e0 then 'HEIGHT_LIMIT'
      when width_max < greatest(0.02e0, 0.1e0 - range * 0.005e0) or width_max > 0.5e0 then 'WIDTH_LIMIT' when aspect_ratio < 0.25e0 or aspect_ratio > 2 then 'ASPECT_RATIO' when symmetry > 5.5e0 then 'SYMMETRY' else 'NONE' end as rejection_reason from expected""",
    "table": "select *, case when rejection_reason = 'NONE' and point_count >= 2 then 1e0 else 0e0 end as confidence from ruled",
    # duplicates
    "cone": "select *, row_number() over (partition by frame_id order by cluster_id) as k from \"table\" where confidence > 0.5e0",
    "dfold": """select frame_id, k, [struct_pack(id := cluster_id, x := x, y := y)] as seeds from cone where k = 1 union all
      select o.frame_id, o.k, case when len(list_filter(f.seeds, lambda s: (s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y) < 0.45e0 * 0.45e0)) > 0 then f.seeds
        else list_append(f.seeds, struct_pack(id := o.cluster_id, x := o.x, y := o.y)) end from dfold f join cone o on o.frame_id = f.frame_id and o.k = f.k + 1""",
    "dseeds": "select frame_id, unnest(arg_max(seeds, k)) as s from dfold group by frame_id",
    "dseeded": "select o.frame_id, o.cluster_id, min(s.id) as seed_id from cone o join dseeds using (frame_id) where (s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y) < 0.45e0 * 0.45e0 group by all",
    "dmean": "select o.frame_id, d.seed_id as cluster_id, count(*) as merged, avg(o.x) as mx, avg(o.y) as my, avg(o.z) as mz from cone o join dseeded d using (frame_id, cluster_id) group by all",
    "final": """select c.* exclude (x, y, z, range, bearing), merged, case when merged > 1 then mx else x end as x, case when merged > 1 then my else y end as y, case when merged > 1 then mz else z end as z,
      case when merged > 1 then sqrt(mx * mx + my * my) else range end as range, case when merged > 1 then atan2(my, mx) else bearing end as bearing from cone c join dmean using (frame_id, cluster_id)""",
}
ORDER = list(CTE)
RAW = ("points", "wide", "imu", "poses", "frames", "profiles", "log")


def twin(final: str, upto: str | None = None, *more: str) -> str:
    """final with the CTEs of the point pipeline up to `upto`, and the raw tables named in `more`."""
    names = list(more)
    if upto in RAW:
        names.append(upto)
    elif upto:
        names += ["points", *ORDER[len(RAW) : ORDER.index(upto) + 1]]
    return "with recursive " + ",\n".join(f'"{n}" as ({CTE[n]})' for n in names) + "\n" + final


_BETWEEN = "case when p is not null and n is not null then case when n = p then a.{0} else (1e0 - (t - p)::double / (n - p)::double) * a.{0} + (t - p)::double / (n - p)::double * b.{0} end else l.{0} end as {0}"
_KNOWN = "(tx <> 0 or ty <> 0 or yaw <> 0)"
_X, _Y, _Z = (f"({v}e0)" for v in fx.ARM)
#: Velocity and heading at each frame, whose time is 1.3 ms after its header. The sensor turns about z only.
MOVES = f""", fr as (select frame_id, header_ts_ns + 1300000 as t from frames),
 ask as (select frame_id, u, t + (u * 1000000)::bigint as t from fr, (select unnest([-50, -25, 0, 25, 50, -20]) as u) us),
 turned as (select *, 2e0 * atan2(qz, qw) as yaw from poses),
 nb as (select *, (select max(ts_ns) from poses where ts_ns <= t) as p, (select min(ts_ns) from poses where ts_ns >= t) as n from ask),
 latest as (select arg_max(tx, ts_ns) as tx, arg_max(ty, ts_ns) as ty, arg_max(yaw, ts_ns) as yaw from turned),
 pos as (select nb.frame_id, u, t, {", ".join(_BETWEEN.format(c) for c in ("tx", "ty", "yaw"))} from nb left join turned a on a.ts_ns = p left join turned b on b.ts_ns = n cross join latest l),
 k as (select frame_id, count(*) filter (u <> -20 and {_KNOWN}) as n5, count(*) filter (u in (0, -20) and {_KNOWN}) as n2, sum(u / 1e3 * tx) filter (u <> -20) as sx, sum(u / 1e3 * ty) filter (u <> -20) as sy,
    max(tx) filter (u = 0) - max(tx) filter (u = -20) as dx, max(ty) filter (u = 0) - max(ty) filter (u = -20) as dy, max(yaw) filter (u = 0) as yaw, max(t) filter (u = 0) as t from pos group by frame_id),
 mv as (select frame_id, t, yaw, case when n5 = 5 then sx / 0.00625e0 when n2 = 2 then dx / 0.02e0 else 0e0 end as vx, case when n5 = 5 then sy / 0.00625e0 when n2 = 2 then dy / 0.02e0 else 0e0 end as vy from k)"""
#: The path over each frame's samples: the inertial unit turns about one axis only, so that turns add up.
PATH = f""", win as (select f.frame_id, f.t, i.ts_ns, i.wz, i.ax, row_number() over (partition by f.frame_id order by i.ts_ns) as k from fr f join imu i on i.ts_ns between f.t - 150000000 and f.t + 150000000),
 mid as (select frame_id, arg_min(k, (abs(ts_ns - t), k)) as m from win group by frame_id having count(*) >= 2),
 st as (select w.frame_id, w.k, w.ts_ns, sign(w.k - m.m) as sd, abs(w.k - m.m) as r, (b.wz + w.wz) / 2e0 as om, (b.ax + w.ax) / 2e0 as ac,
    case when w.k > m.m then case when w.ts_ns - b.ts_ns between 1 and 100000000 then (w.ts_ns - b.ts_ns) / 1e9 else 0.01e0 end when b.ts_ns - w.ts_ns > 100000000 then -0.01e0 else (w.ts_ns - b.ts_ns) / 1e9 end as dt
   from win w join mid m using (frame_id) join win b on b.frame_id = w.frame_id and b.k = w.k - sign(w.k - m.m) where w.k <> m.m),
 th as (select *, sum(om * dt) over (o rows between unbounded preceding and current row) as theta, coalesce(sum(om * dt) over (o rows between unbounded preceding and 1 preceding), 0e0) as th0 from st window o as (partition by frame_id, sd order by r)),
 acc as (select th.*, cos(yaw) * vx + sin(yaw) * vy as v0x, cos(yaw) * vy - sin(yaw) * vx as v0y, cos(th0) * (ac - om * om * {_X}) + sin(th0) * (9.80665e0 - om * om * {_Z}) + 9.80665e0 * sin(yaw) as fx,
    9.80665e0 * cos(yaw) as fy, cos(th0) * (9.80665e0 - om * om * {_Z}) - sin(th0) * (ac - om * om * {_X}) as fz from th join mv using (frame_id)),
 vel as (select *, v0x + coalesce(sum(fx * dt) over o, 0e0) as v1x, v0y + coalesce(sum(fy * dt) over o, 0e0) as v1y, coalesce(sum(fz * dt) over o, 0e0) as v1z from acc window o as (partition by frame_id, sd order by r rows between unbounded preceding and 1 preceding)),
 path as (select frame_id, ts_ns, sin(theta / 2e0) as qy, cos(theta / 2e0) as qw, sum(v1x * dt + fx * dt * dt / 2e0) over o as px, sum(v1y * dt + fy * dt * dt / 2e0) over o as py, sum(v1z * dt + fz * dt * dt / 2e0) over o as pz
    from vel window o as (partition by frame_id, sd order by r rows between unbounded preceding and current row)
   union all select w.frame_id, w.ts_ns, 0e0, 1e0, 0e0, 0e0, 0e0 from win w join mid m on m.frame_id = w.frame_id and m.m = w.k)"""
#: Points at their frame's time.
MOVED = f""", pts as (select p.frame_id, point_idx, x, y, z, trunc(timestamp * 1e9)::bigint as ts, t from points p join mv using (frame_id)),
 around as (select pts.*, coalesce(b.ts_ns, n.ts_ns) as t0, coalesce(n.ts_ns, b.ts_ns) as t1, coalesce(b.qy, n.qy) as y0, coalesce(n.qy, b.qy) as y1, coalesce(b.qw, n.qw) as w0, coalesce(n.qw, b.qw) as w1,
    coalesce(b.px, n.px) as px0, coalesce(n.px, b.px) as px1, coalesce(b.py, n.py) as py0, coalesce(n.py, b.py) as py1, coalesce(b.pz, n.pz) as pz0, coalesce(n.pz, b.pz) as pz1
   from pts asof left join path b on b.frame_id = pts.frame_id and pts.ts > b.ts_ns asof left join path n on n.frame_id = pts.frame_id and pts.ts <= n.ts_ns),
 placed as (select *, case when t1 > t0 then greatest(0e0, least(1e0, (ts - t0)::double / (t1 - t0)::double)) else 0e0 end as a, x - {_X} as rx, z - {_Z} as rz, abs((ts::double - t::double) / 1e9) <= 0.15e0 as go from around),
 quat as (select *, ((1e0 - a) * y0 + a * y1) as uy, ((1e0 - a) * w0 + a * w1) as uw from placed),
 unit as (select *, uy / sqrt(uy * uy + uw * uw) as s, uw / sqrt(uy * uy + uw * uw) as c from quat),
 desk as (select frame_id, point_idx, case when go then (1e0 - 2e0 * s * s) * rx + 2e0 * c * s * rz + {_X} + (1e0 - a) * px0 + a * px1 else x end as nx, case when go then y + (1e0 - a) * py0 + a * py1 else y end as ny,
    case when go then (1e0 - 2e0 * s * s) * rz - 2e0 * c * s * rx + {_Z} + (1e0 - a) * pz0 + a * pz1 else z end as nz, x, y, z, go from unit),
 gone as (select *, case when go then sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) end as moved from desk)"""


def moving(final: str, upto: str | None = None) -> str:
    """final behind the twins of motion compensation, and of the point pipeline up to `upto` over the points that it moved."""
    names = ["points", "imu", "poses", "frames"]
    text = "with recursive " + ",\n".join(f'"{n}" as ({CTE[n]})' for n in names) + MOVES + PATH + MOVED
    for n in ORDER[len(RAW) : ORDER.index(upto) + 1] if upto else ():
        if n == "norm":
            text += f',\n"norm0" as ({CTE[n]}),\n"norm" as (select m.* replace (nx as x, ny as y, nz as z) from norm0 m join (select frame_id, point_idx, nx, ny, nz from desk) d using (frame_id, point_idx))'
        else:
            text += f',\n"{n}" as ({CTE[n]})'
    return text + "\n" + final
