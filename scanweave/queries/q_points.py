"""Per-point operators, filters, aggregates and the chain from sweeps to cones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import features as ft
from ..operators import ground as gr
from ..operators import joins as jn
from ..operators.cluster import CLUSTERERS
from ..operators.greedy import aggregate_duplicates, centroids, merge_clusters, seeds_of
from ..plans import pipeline as pl
from ..sources import fixtures as fx
from .twin import BIN, COLUMN, SECTOR, moving, twin

C = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles to so many digits, or to a column's own number of them; zero has no sign."""
    return df.select(*((F.round(c, own.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else C(c) for c, t in df.dtypes))


def r(*cs: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cs)


P = ("frame_id", "point_idx")

# ---- scalars


@query(
    "point_timestamp",
    twin(
        """, raw as (select frame_id, point_idx, 1700000000000000000 + frame_id * 100000000 as header_ns,
          case point_idx % 4 when 0 then 1.7e18 + point_idx * 1e6 when 1 then 1.7e9 + point_idx / 1e3 when 2 then point_idx / 1e4 end as raw from points)
        select frame_id, point_idx, round(case when raw is null then header_ns::double / 1e9
          when raw > 1e9 then (trunc((case when raw > 1e15 then raw / 1e9 else raw end) * 1e9)::bigint - 20000000000)::double / 1e9
          else header_ns::double / 1e9 + raw end, 5) as ts from raw""",
        "points",
    ).replace("\n,", ","),
)
def point_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    i = C("point_idx")
    raw = F.when(i % 4 == 0, 1.7e18 + i * 1e6).when(i % 4 == 1, 1.7e9 + i / 1e3).when(i % 4 == 2, i / 1e4)
    header = F.lit(1700000000000000000) + C("frame_id") * 100000000
    return fx.points(spark, sf).select(*P, F.round(s.point_timestamp(raw, header, F.lit(20000000000), F.lit(True)), 5).alias("ts"))


@query("clock_align_ts", twin("select frame_id, case when frame_id > 0 then header_ts_ns - (20000000000 + frame_id) else header_ts_ns end as aligned_ns from frames", "frames"))
def clock_align_ts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.frames(spark, sf).select("frame_id", s.align_clock(C("header_ts_ns"), F.lit(20000000000) + C("frame_id"), C("frame_id") > 0).alias("aligned_ns"))


@query("intensity_norm", twin("select frame_id, point_idx, round(intensity, 6) as intensity from norm", "norm"))
def intensity_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pl.prepared(fx.points(spark, sf)).select(*P, "intensity"))


@query("polar_coords", twin("select frame_id, point_idx, round(sqrt(x * x + y * y), 6) as range, round(atan2(y, x), 6) as bearing from points", "points"))
def polar_coords(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.points(spark, sf).select(*P, s.planar_range(C("x"), C("y")).alias("range"), s.bearing(C("x"), C("y")).alias("bearing")))


@query("polar_bin_key", twin(f"select frame_id, point_idx, {SECTOR(500)} as seg, {BIN} as bin from points", "points"))
def polar_bin_key(spark: SparkSession, sf: str) -> DataFrame:
    return fx.points(spark, sf).select(*P, s.sector(C("x"), C("y"), 500).alias("seg"), s.radial_bin(C("x"), C("y"), 500, 25.0).alias("bin"))


@query("grid_key", twin("select frame_id, point_idx, cast(floor(x / 0.12e0) as int) as cx, cast(floor(y / 0.12e0) as int) as cy from points where abs(x) <= 25 and abs(y) <= 25", "points"))
def grid_key(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.points(spark, sf).filter("abs(x) <= 25 and abs(y) <= 25")
    return p.select(*P, s.cell(C("x"), 0.12).alias("cx"), s.cell(C("y"), 0.12).alias("cy"))


@query("voxel_key", twin("select frame_id, point_idx, cast(floor(x / 0.02e0) as int) as vx, cast(floor(y / 0.02e0) as int) as vy, cast(floor(z / 0.02e0) as int) as vz from points", "points"))
def voxel_key(spark: SparkSession, sf: str) -> DataFrame:
    return fx.points(spark, sf).select(*P, *(s.cell(C(c), 0.02).alias("v" + c) for c in "xyz"))


@query(
    "dbscan_cell_key",
    twin("select frame_id, point_idx, cast(trunc((x + 30e0) / 0.3e0) as int) as gx, cast(trunc((y + 30e0) / 0.3e0) as int) as gy, cast(trunc((z + 2e0) / 0.3e0) as int) as gz from points where x >= -30 and y >= -30 and z >= -2", "points"),
)
def dbscan_cell_key(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.points(spark, sf).filter("x >= -30 and y >= -30 and z >= -2")
    return p.select(*P, s.toward_zero((C("x") + 30.0) / 0.3).alias("gx"), s.toward_zero((C("y") + 30.0) / 0.3).alias("gy"), s.toward_zero((C("z") + 2.0) / 0.3).alias("gz"))


@query("range_image_key", twin(f"select frame_id, point_idx, ring, {COLUMN} as col from points where ring between 0 and 39", "points"))
def range_image_key(spark: SparkSession, sf: str) -> DataFrame:
    return fx.points(spark, sf).filter(s.in_image(C("ring"))).select(*P, "ring", s.image_column(C("x"), C("y")).alias("col"))


@query(
    "ring_v_res",
    twin(
        "select ring, count(*) as n, round(max(case when ring between 6 and 30 then 0.33e0 when ring between 5 and 6 or ring between 30 and 38 then 1e0 when ring between 4 and 5 then 2e0 when ring between 2 and 4 then 3e0 when ring between 1 and 2 then 4e0 when ring between 38 and 39 then 5e0 else 6e0 end * 3.141592653589793e0 / 180e0), 9) as v_res from points group by ring",
        "points",
    ),
)
def ring_v_res(spark: SparkSession, sf: str) -> DataFrame:
    return fx.points(spark, sf).groupBy("ring").agg(F.count("*").alias("n"), F.round(F.max(s.ring_step(C("ring"))), 9).alias("v_res"))


@query(
    "beta_angle",
    twin("select frame_id, point_idx, round(atan2(least(d1, d2) * sin(0.006e0), greatest(d1, d2) - least(d1, d2) * cos(0.006e0)), 6) as beta from (select frame_id, point_idx, sqrt(x * x + y * y) as d1, sqrt(x * x + y * y + z * z) + 0.01e0 as d2 from points) t", "points"),
)
def beta_angle(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = C("x"), C("y"), C("z")
    return rounded(fx.points(spark, sf).select(*P, s.beta(F.sqrt(x * x + y * y), F.sqrt(x * x + y * y + z * z) + 0.01, F.lit(0.006)).alias("beta")))


# ---- filters


@query("spatial_truncate", twin("select frame_id, point_idx, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from wide where x * x + y * y between 0.0625e0 and 625e0 and isfinite(x) and isfinite(y) and isfinite(z)", "wide"))
def spatial_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gr.spatial_truncate(fx.points(spark, sf, wide=True)).select(*P, "x", "y", "z"))


@query("cluster_size_filter", twin("select frame_id, root as anchor, count(*) as n from member0 group by all having count(*) between 2 and 300", "member0"))
def cluster_size_filter(spark: SparkSession, sf: str) -> DataFrame:
    left = pl.obstacles(fx.points(spark, sf))
    n = left.join(CLUSTERERS["grid"](left), list(P)).groupBy("frame_id", "cluster_id").agg(F.min("point_idx").alias("anchor"), F.count("*").alias("n"))
    return n.filter(C("n").between(2, 300)).select("frame_id", "anchor", "n")


@query("min_cluster_refilter", twin("select frame_id, cluster_id, n from cent where n >= 10", "cent"))
def min_cluster_refilter(spark: SparkSession, sf: str) -> DataFrame:
    return _members0(spark, sf).groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n")).filter("n >= 10")


@query("confidence_gate", twin('select frame_id, cluster_id from "table" where confidence > 0.5e0', "table"))
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ft.accepted(pl.cluster_table(fx.points(spark, sf))).select("frame_id", "cluster_id")


@query("deskew_time_gate", twin("select frame_id, point_idx, abs(timestamp - (1.7e9 + frame_id * 0.1e0 + 0.2e0)) > 0.15e0 as outside from points", "points"))
def deskew_time_gate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.deskew import outside_gate

    return fx.points(spark, sf).select(*P, outside_gate(C("timestamp"), 1.7e9 + C("frame_id") * 0.1 + 0.2).alias("outside"))


@query("empty_guards", twin("select frame_id, count(*) as n from points where x > 1e6 group by frame_id", "points"))
def empty_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Frames without points have no rows: a pipeline over none gives none."""
    return pl.prepared(fx.points(spark, sf).filter("x > 1e6")).groupBy("frame_id").agg(F.count("*").alias("n"))


# ---- neighbour joins


@query("bin_min_join", twin("select frame_id, point_idx, seg, bin, round(cell_min_z, 6) as cell_min_z from celled", "celled"))
def bin_min_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gr.with_cell_min(pl.prepared(fx.points(spark, sf))).select(*P, "seg", "bin", "cell_min_z"))


@query("cell_min_z", twin("select frame_id, seg, bin, round(min(z), 6) as min_z, count(*) as n from polar group by all", "polar"))
def cell_min_z(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gr.with_cell_min(pl.prepared(fx.points(spark, sf))).groupBy("frame_id", "seg", "bin").agg(F.min("z").alias("min_z"), F.count("*").alias("n")))


@query(
    "cell_neighbour_join",
    twin("select a.frame_id, a.cx, a.cy, b.cx as nx, b.cy as ny from cells a join cells b on a.frame_id = b.frame_id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and (a.cx < b.cx or a.cx = b.cx and a.cy < b.cy)", "cells"),
)
def cell_neighbour_join(spark: SparkSession, sf: str) -> DataFrame:
    return jn.touching_cells(jn.grid_cells(pl.obstacles(fx.points(spark, sf))))


@query(
    "radius_join",
    twin(
        "select a.frame_id, a.point_idx as a, b.point_idx as b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 6) as d2 from obs a join obs b on a.frame_id = b.frame_id and a.point_idx < b.point_idx and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.3e0 * 0.3e0",
        "obs",
    ),
)
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(jn.radius_pairs(pl.obstacles(fx.points(spark, sf)), 0.30))


_KNN = """select a.frame_id, a.point_idx, b.point_idx as nbr, case when a.point_idx = b.point_idx then -1e0 else (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) end as d2
  from obs a join obs b on a.frame_id = b.frame_id"""


@query(
    "knn_join",
    twin(f"select frame_id, point_idx, rank, round(sqrt(greatest(0e0, d2)), 6) as d from (select *, cast(row_number() over (partition by frame_id, point_idx order by d2, nbr) - 1 as int) as rank from ({_KNN}) k) t where rank < 8", "obs"),
)
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    got = jn.nearest_neighbours(pl.obstacles(fx.points(spark, sf)), 8, 0.15)
    return rounded(got.select(*P, C("rank").cast("int").alias("rank"), "d"))


@query(
    "knn_topk",
    twin(f"select frame_id, point_idx, round(sqrt(greatest(0e0, max(d2))), 6) as kth from (select *, row_number() over (partition by frame_id, point_idx order by d2, nbr) - 1 as rank from ({_KNN}) k) t where rank < 5 group by frame_id, point_idx", "obs"),
)
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    got = jn.nearest_neighbours(pl.obstacles(fx.points(spark, sf)), 5, 0.12)
    return rounded(got.groupBy(*P).agg(F.max("d").alias("kth")))


_IMAGE = f", img as (select frame_id, ring, col, min(struct_pack(d := d, i := point_idx)) as p from (select *, {COLUMN} as col, sqrt(x * x + y * y + z * z) as d from obs) t group by all)"
_STEP = "(case when a.ring between 6 and 30 then 0.33e0 when a.ring between 5 and 6 or a.ring between 30 and 38 then 1e0 when a.ring between 4 and 5 then 2e0 when a.ring between 2 and 4 then 3e0 when a.ring between 1 and 2 then 4e0 when a.ring between 38 and 39 then 5e0 else 6e0 end * 3.141592653589793e0 / 180e0)"


@query("range_image_argmin", twin(_IMAGE + " select frame_id, ring, col, p.i as point_idx, round(p.d, 6) as d from img", "obs").replace("\n,", ","))
def range_image_argmin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(jn.range_image(pl.obstacles(fx.points(spark, sf))))


@query(
    "range_image_neighbour",
    twin(
        _IMAGE
        + f""", pair as (select a.frame_id, a.p.i as a, b.p.i as b, a.p.d as d0, b.p.d as d1, case when a.ring <> b.ring then abs(a.ring - b.ring) * {_STEP} else least((a.col - b.col + 2048) % 2048, (b.col - a.col + 2048) % 2048) * (2e0 * 3.141592653589793e0 / 2048) end as al
      from img a join img b on a.frame_id = b.frame_id and abs(a.ring - b.ring) <= 2 and least((a.col - b.col + 2048) % 2048, (b.col - a.col + 2048) % 2048) <= 2 and (a.ring <> b.ring or a.col <> b.col))
    select frame_id, a, b, round(atan2(least(d0, d1) * sin(al), greatest(d0, d1) - least(d0, d1) * cos(al)), 6) as beta from pair
    where atan2(least(d0, d1) * sin(al), greatest(d0, d1) - least(d0, d1) * cos(al)) > 10e0 * 3.141592653589793e0 / 180e0""",
        "obs",
    ).replace("\n,", ","),
)
def range_image_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(jn.image_edges(jn.range_image(pl.obstacles(fx.points(spark, sf)))))


# ---- ground


@query("ground_bin", twin(f"select frame_id, point_idx, case when z >= -0.47e0 and z > m + 0.02e0 then 'obstacle' else 'ground' end as label from (select *, min(z) over (partition by frame_id, {SECTOR(500)}, {BIN}) as m from wide where sqrt(x * x + y * y) between 0.5e0 and 25e0) t", "wide"))
def ground_bin(spark: SparkSession, sf: str) -> DataFrame:
    return gr.ground_bin(fx.points(spark, sf, wide=True)).select(*P, "label")


_RADIAL = f", rad as (select *, row_number() over (partition by frame_id, seg order by r2, point_idx) as rank from (select *, {SECTOR(360)} as seg, x * x + y * y as r2 from wide) t)"


@query("radial_sort", twin(_RADIAL + " select frame_id, point_idx, seg, cast(rank as int) as rank from rad", "wide").replace("\n,", ","))
def radial_sort(spark: SparkSession, sf: str) -> DataFrame:
    return gr.radial_order(fx.points(spark, sf, wide=True)).select(*P, "seg", "rank")


_GROUND = "case when r.rr < 0.5e0 then true else (case when r.rr - w.lr > 0.05e0 then abs(r.z - w.lz) / (r.rr - w.lr) < 0.08e0 and abs(r.z - w.lz) < 0.05e0 else abs(r.z - w.lz) < 0.05e0 end) or (r.z < -0.52e0 + 0.05e0 and r.rr < 3e0) end"


@query(
    "ground_slope",
    twin(
        _RADIAL
        + f""", rr as (select frame_id, point_idx, seg, rank, z, sqrt(r2) as rr from rad),
    slope as (select frame_id, seg, 0::bigint as rank, -1::bigint as point_idx, false as g, 0e0 as lr, -0.52e0 as lz from rr group by frame_id, seg
      union all select r.frame_id, r.seg, r.rank, r.point_idx, {_GROUND}, case when r.rr >= 0.5e0 and {_GROUND} then r.rr else w.lr end, case when r.rr >= 0.5e0 and {_GROUND} then r.z else w.lz end
      from slope w join rr r on r.frame_id = w.frame_id and r.seg = w.seg and r.rank = w.rank + 1)
    select frame_id, point_idx, case when g then 'ground' else 'obstacle' end as label from slope where rank > 0""",
        "wide",
    ).replace("\n,", ","),
)
def ground_slope(spark: SparkSession, sf: str) -> DataFrame:
    return gr.ground_slope(fx.points(spark, sf, wide=True)).select(*P, "label")


@query("ground_patchwork")
def ground_patchwork(spark: SparkSession, sf: str) -> DataFrame:
    return gr.ground_zones(fx.points(spark, sf)).select(*P, "label")


@query("voxel_downsample", twin("select frame_id, cast(floor(x / 0.1e0) as int) as vx, cast(floor(y / 0.1e0) as int) as vy, cast(floor(z / 0.1e0) as int) as vz, min(point_idx) as point_idx, count(*) as n, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 9) as z, round(avg(intensity), 9) as intensity from obs group by 1, 2, 3, 4", "obs"))
def voxel_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gr.voxel_downsample(pl.obstacles(fx.points(spark, sf)), 0.1), z=9, intensity=9)


# ---- clusters


def _members0(spark: SparkSession, sf: str) -> DataFrame:
    left = pl.obstacles(fx.points(spark, sf))
    return left.join(CLUSTERERS["grid"](left), list(P))


def _labels(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return CLUSTERERS[name](pl.obstacles(fx.points(spark, sf))).select(*P, "cluster_id")

    return run


def _component_sql(edges: str, nodes: str = "select frame_id, point_idx as node from obs") -> str:
    """Least node of each component of an edge query (frame_id, a, b)."""
    return f""", nd as ({nodes}), ed as ({edges}), both_ as (select frame_id, a, b from ed union all select frame_id, b, a from ed),
    reach as (select frame_id, node, node as label from nd union select e.frame_id, e.b, w.label from reach w join both_ e on e.frame_id = w.frame_id and e.a = w.node and w.label < e.b),
    comp as (select frame_id, node, min(label) as root from reach group by all)"""


_NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {0} * {0}"
_VOX = """select distinct a.frame_id, a.idx as a, b.idx as b from vx a join vx b on a.frame_id = b.frame_id and abs(a.vx - b.vx) <= 1 and abs(a.vy - b.vy) <= 1 and abs(a.vz - b.vz) <= 1 and a.idx < b.idx"""

query("cluster_grid", twin("select frame_id, point_idx, cluster_id from members", "members"))(_labels("grid"))
query(
    "cluster_voxel",
    twin(
        ", vx as (select frame_id, cast(floor(x / 0.02e0) as int) as vx, cast(floor(y / 0.02e0) as int) as vy, cast(floor(z / 0.02e0) as int) as vz, min(point_idx) as idx from obs group by all)"
        + _component_sql(_VOX, "select frame_id, idx as node from vx")
        + """, lab as (select o.frame_id, o.point_idx, c.root, count(*) over (partition by o.frame_id, c.root) as n from obs o join vx v on v.frame_id = o.frame_id and v.vx = cast(floor(o.x / 0.02e0) as int) and v.vy = cast(floor(o.y / 0.02e0) as int) and v.vz = cast(floor(o.z / 0.02e0) as int) join comp c on c.frame_id = v.frame_id and c.node = v.idx)
    select frame_id, point_idx, cast(dense_rank() over (partition by frame_id order by root) - 1 as int) as cluster_id from lab where n between 2 and 300""",
        "obs",
    ).replace("\n,", ","),
)(_labels("voxel"))
query(
    "cluster_dbscan",
    twin(
        f""", ne as (select a.frame_id, a.point_idx as a, b.point_idx as b from obs a join obs b on a.frame_id = b.frame_id and {_NEAR.format("0.3e0")}),
    core as (select frame_id, a as node from ne group by all having count(*) >= 3)"""
        + _component_sql("select n.frame_id, n.a, n.b from ne n join core c on c.frame_id = n.frame_id and c.node = n.a join core d on d.frame_id = n.frame_id and d.node = n.b where n.a < n.b", "select * from core")
        + """, lab as (select frame_id, node as point_idx, root from comp union all select n.frame_id, n.a, min(c.root) from ne n join comp c on c.frame_id = n.frame_id and c.node = n.b where (n.frame_id, n.a) not in (select frame_id, node from core) group by all),
    cnt as (select *, count(*) over (partition by frame_id, root) as n from lab)
    select frame_id, point_idx, cast(dense_rank() over (partition by frame_id order by root) - 1 as int) as cluster_id from cnt where n between 2 and 300""",
        "obs",
    ).replace("\n,", ","),
)(_labels("dbscan"))
query(
    "cluster_euclidean",
    twin(
        _component_sql(f"select a.frame_id, a.point_idx as a, b.point_idx as b from obs a join obs b on a.frame_id = b.frame_id and a.point_idx < b.point_idx and {_NEAR.format('0.35e0')}")
        + """, lab as (select frame_id, node as point_idx, root, count(*) over (partition by frame_id, root) as n from comp)
    select frame_id, point_idx, cast(dense_rank() over (partition by frame_id order by -n, root) - 1 as int) as cluster_id from lab where n between 2 and 300""",
        "obs",
    ).replace("\n,", ","),
)(_labels("euclidean"))
query("cluster_depth")(_labels("depth"))
query("cluster_hdbscan")(_labels("hdbscan"))


@query(
    "euclidean_order",
    twin(
        _component_sql(f"select a.frame_id, a.point_idx as a, b.point_idx as b from obs a join obs b on a.frame_id = b.frame_id and a.point_idx < b.point_idx and {_NEAR.format('0.35e0')}")
        + """, lab as (select frame_id, root as first_idx, count(*) as n from comp group by all having count(*) between 2 and 300)
    select frame_id, cast(row_number() over (partition by frame_id order by n desc, first_idx) - 1 as int) as cluster_id, n, first_idx from lab""",
        "obs",
    ).replace("\n,", ","),
)
def euclidean_order(spark: SparkSession, sf: str) -> DataFrame:
    return _labels("euclidean")(spark, sf).groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n"), F.min("point_idx").alias("first_idx"))


@query("edge_sort")
def edge_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual-reachability edges of each frame in joining order."""
    import numpy as np

    from ..config import DEFAULT
    from ..operators.cluster import reach_edges
    from ..operators.frames import per_frame

    def kernel(f):
        u, v, w = reach_edges(np.stack([f["x"], f["y"], f["z"]], 1), DEFAULT)
        o = np.lexsort((v, u, w))
        i = f["point_idx"]
        return {"rank": np.arange(len(o)).astype(np.int32), "u": i[u[o]], "v": i[v[o]], "weight": np.round(w[o], 6)}

    return per_frame(pl.obstacles(fx.points(spark, sf)).select(*P, "x", "y", "z"), kernel, "frame_id bigint, rank int, u bigint, v bigint, weight double")


# ---- merge, features, rules


@query("centroid", twin(f"select frame_id, cluster_id, n, {r('cx', 'cy')}, round(cz, 9) as cz from cent", "cent"))
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(centroids(_members0(spark, sf)), cz=9)


@query("merge_self_join", twin("select frame_id, cluster_id, seed_id from seeded", "seeded"))
def merge_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return seeds_of(centroids(_members0(spark, sf)), 0.25)


@query("merge_clusters", twin("select frame_id, point_idx, cluster_id from merged", "merged"))
def merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge_clusters(_members0(spark, sf)).select(*P, "cluster_id")


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return pl.clustered(fx.points(spark, sf))


@query("aabb", twin(f"select frame_id, cluster_id, {r('min_x', 'max_x', 'min_y', 'max_y', 'min_z', 'max_z')} from mom", "mom"))
def aabb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.aabb(_merged(spark, sf)))


@query("avg_intensity", twin("select frame_id, cluster_id, round(avg_intensity, 6) as avg_intensity from mom", "mom"))
def avg_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.moments(_merged(spark, sf)).select("frame_id", "cluster_id", "avg_intensity"))


_COV = ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")


@query("mean_cov", twin(f"select frame_id, cluster_id, round(x, 6) as mean_x, round(y, 6) as mean_y, round(mean_z, 9) as mean_z, {r(*_COV, digits=12)} from mom", "mom"))
def mean_cov(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.moments(_merged(spark, sf)).select("frame_id", "cluster_id", "mean_x", "mean_y", "mean_z", *_COV), 12, mean_x=6, mean_y=6, mean_z=9)


_EIG = ("linearity", "planarity", "scattering", "verticality")


@query("eig3_features", twin(f"select frame_id, cluster_id, {r(*_EIG, digits=4)} from feat", "feat"))
def eig3_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.features(_merged(spark, sf)).select("frame_id", "cluster_id", *_EIG), 4)


_SHAPE = ("height", "width_max", "width_min", "aspect_ratio", "symmetry", "z")


@query("shape_ratios", twin(f"select frame_id, cluster_id, {r(*_SHAPE)} from feat", "feat"))
def shape_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.features(_merged(spark, sf)).select("frame_id", "cluster_id", *_SHAPE))


@query("cone_rules", twin('select frame_id, cluster_id, point_count, rejection_reason, confidence from "table"', "table"))
def cone_rules(spark: SparkSession, sf: str) -> DataFrame:
    return pl.cluster_table(fx.points(spark, sf)).select("frame_id", "cluster_id", "point_count", "rejection_reason", "confidence")


_CONE = ("x", "y", "z", "range", "bearing", "height")


@query("aggregate_duplicates", twin(f"select frame_id, cluster_id, merged, {r(*_CONE)} from final", "final"))
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    c = ft.accepted(pl.cluster_table(fx.points(spark, sf)))
    return rounded(aggregate_duplicates(c).select("frame_id", "cluster_id", "merged", *_CONE))


def motion_of(spark: SparkSession, sf: str) -> pl.Motion:
    """What the fixture has of motion; a frame's time is 1.3 ms after its header."""
    return pl.Motion(fx.frames(spark, sf).withColumn("header_ts_ns", C("header_ts_ns") + 1_300_000), fx.imu(spark, sf), fx.edges(spark, sf))


@query("pipeline_cones", moving(f"select frame_id, cluster_id, {r(*_CONE)}, confidence, 'UNKNOWN' as color from final", "final"))
def pipeline_cones(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pl.cones(fx.points(spark, sf), move=motion_of(spark, sf)).select("frame_id", "cluster_id", *_CONE, "confidence", "color"))


@query("pipeline_cones_still", twin(f"select frame_id, cluster_id, {r(*_CONE)}, confidence, 'UNKNOWN' as color from final", "final"))
def pipeline_cones_still(spark: SparkSession, sf: str) -> DataFrame:
    """Without motion compensation, as `use_deskewing` false gives it."""
    cfg = pl.BATCH.override(use_deskewing=False)
    return rounded(pl.cones(fx.points(spark, sf), cfg, motion_of(spark, sf)).select("frame_id", "cluster_id", *_CONE, "confidence", "color"))


@query(
    "frame_counts",
    twin(
        """select frame_id, (select count(*) from points p where p.frame_id = f.frame_id) as raw, (select count(*) from obs o where o.frame_id = f.frame_id) as obstacles,
      (select count(distinct cluster_id) from merged m where m.frame_id = f.frame_id) as clusters, (select count(*) from final c where c.frame_id = f.frame_id) as cones from (select distinct frame_id from points) f""",
        "final",
    ),
)
def frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.points(spark, sf)
    n = lambda df, name: df.groupBy("frame_id").agg(F.count("*").alias(name))
    parts = [n(pl.obstacles(raw), "obstacles"), n(pl.cluster_table(raw), "clusters"), n(pl.cones(raw), "cones")]
    out = n(raw, "raw")
    for p in parts:
        out = out.join(p, "frame_id", "left")
    return out.fillna(0)
