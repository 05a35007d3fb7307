"""Joins over time, clocks, velocities and motion compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.rotation import euler_matrix, extrinsic, nlerp, rodrigues, rotate
from ..operators import deskew as dk
from ..operators import temporal as tm
from ..sources import fixtures as fx
from ..sources.tf import lookup, static_transforms
from .q_points import rounded
from .twin import moving, twin

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


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return fx.frames(spark, sf).withColumn("header_ts_ns", C("header_ts_ns") + 1_300_000)


_F = ", fr as (select frame_id, header_ts_ns + 1300000 as t from frames)"


def _sql(body: str, *tables: str) -> str:
    return twin(body, None, *tables).replace("\n,", ",")


@query(
    "imu_clamp",
    _sql(
        "select seq, round(case when isnan(w) then 0e0 else greatest(-15e0, least(15e0, w)) end, 6) as w, round(greatest(-80e0, least(80e0, a)), 6) as a from (select seq, case when seq % 11 = 0 then 'nan'::double else wz * 20e0 end as w, ax * 200e0 as a from imu) t",
        "imu",
    ),
)
def imu_clamp(spark: SparkSession, sf: str) -> DataFrame:
    w = F.when(C("seq") % 11 == 0, F.lit(float("nan"))).otherwise(C("wz") * 20.0)
    return rounded(fx.imu(spark, sf).select("seq", s.clamped(w, s.GYRO_LIMIT).alias("w"), s.clamped(C("ax") * 200.0, s.ACCEL_LIMIT).alias("a")))


@query("imu_window_join", _sql(_F + " select frame_id, seq, i.ts_ns - t as gap_ns from fr join imu i on i.ts_ns between t - 150000000 and t + 150000000", "imu", "frames"))
def imu_window_join(spark: SparkSession, sf: str) -> DataFrame:
    return tm.window_join(_frames(spark, sf), fx.imu(spark, sf)).select("frame_id", "seq", (C("ts_ns") - C("header_ts_ns")).alias("gap_ns"))


_INTERP = """, nb as (select fr.frame_id, t, (select max(ts_ns) from {0} where ts_ns <= t) as p, (select min(ts_ns) from {0} where ts_ns >= t) as n from fr),
 iv as (select nb.frame_id, {1} from nb left join {0} a on a.ts_ns = p left join {0} b on b.ts_ns = n)"""
_MIX = "case when p is null then coalesce(b.{0}, 0e0) when n is null then a.{0} when n = p then a.{0} else (1e0 - (t - p)::double / (n - p)::double) * a.{0} + (t - p)::double / (n - p)::double * b.{0} end as {0}"


@query("imu_interp", _sql(_F + _INTERP.format("imu", ", ".join(_MIX.format(c) for c in ("wz", "ax"))) + " select frame_id, round(wz, 6) as wz, round(ax, 6) as ax from iv", "imu", "frames"))
def imu_interp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tm.interpolated(_frames(spark, sf).select("frame_id", "header_ts_ns"), fx.imu(spark, sf), "header_ts_ns", ["wz", "ax"]).select("frame_id", "wz", "ax"))


@query(
    "nearest_sample",
    _sql(_F + " select frame_id, arg_min(seq, (abs(i.ts_ns - t), i.ts_ns, seq)) as seq, min(abs(i.ts_ns - t)) as gap from fr join imu i on i.ts_ns between t - 150000000 and t + 150000000 group by frame_id", "imu", "frames"),
)
def nearest_sample(spark: SparkSession, sf: str) -> DataFrame:
    return tm.nearest_sample(_frames(spark, sf), fx.imu(spark, sf)).select("frame_id", "seq", "gap")


@query("imu_sorted_insert", _sql("select seq, ts_ns, cast(row_number() over (order by ts_ns, seq) - 1 as int) as slot from (select seq, ts_ns - (seq % 3) * 2500000 as ts_ns from imu order by ts_ns - (seq % 3) * 2500000 desc, seq desc limit 2000) t", "imu"))
def imu_sorted_insert(spark: SparkSession, sf: str) -> DataFrame:
    late = fx.imu(spark, sf).select("seq", (C("ts_ns") - (C("seq") % 3) * 2500000).alias("ts_ns"))
    return tm.sorted_cache(late).select("seq", "ts_ns", "slot")


@query(
    "velocity_ols",
    _sql(
        """, ask as (select frame_id, u, header_ts_ns + 1300000 + (u * 1000000)::bigint as t from frames, (select unnest([-50, -25, 0, 25, 50, -20]) as u) us),
     nb as (select *, (select max(ts_ns) from poses where ts_ns <= t) as p, (select min(ts_ns) from poses where ts_ns >= t) as n from ask),
     last as (select arg_max(tx, ts_ns) as tx, arg_max(ty, ts_ns) as ty from poses),
     pos as (select nb.frame_id, u, case when p is not null and n is not null then case when n = p then a.tx else (1e0 - (t - p)::double / (n - p)::double) * a.tx + (t - p)::double / (n - p)::double * b.tx end else l.tx end as tx,
        case when p is not null and n is not null then case when n = p then a.ty else (1e0 - (t - p)::double / (n - p)::double) * a.ty + (t - p)::double / (n - p)::double * b.ty end else l.ty end as ty
       from nb left join poses a on a.ts_ns = p left join poses b on b.ts_ns = n cross join last l),
     k as (select frame_id, count(*) filter (u <> -20 and (tx <> 0 or ty <> 0)) as n5, count(*) filter (u in (0, -20) and (tx <> 0 or ty <> 0)) as n2, sum(u / 1e3 * tx) filter (u <> -20) as sx, sum(u / 1e3 * ty) filter (u <> -20) as sy,
        max(tx) filter (u = 0) - max(tx) filter (u = -20) as dx, max(ty) filter (u = 0) - max(ty) filter (u = -20) as dy from pos group by frame_id)
     select frame_id, round(case when n5 = 5 then sx / 0.00625e0 when n2 = 2 then dx / 0.02e0 else 0e0 end, 6) as vx, round(case when n5 = 5 then sy / 0.00625e0 when n2 = 2 then dy / 0.02e0 else 0e0 end, 6) as vy from k""",
        "poses", "frames",
    ),
)
def velocity_ols(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tm.velocity(_frames(spark, sf), fx.poses(spark, sf)).select("frame_id", "vx", "vy"))


@query(
    "clock_offset_ema",
    _sql(
        """, arr as (select event_id % 4 as sensor, event_id as seq, 30000000000 * (event_id % 4) + (event_id * 7919) % 50000000 as diff from events),
     ord as (select *, row_number() over (partition by sensor order by seq) as k from arr),
     ema as (select sensor, seq, k, case when abs(diff) < 10000000000 then 0 else diff end as init, case when abs(diff) < 10000000000 then 0 else diff end as off from ord where k = 1
       union all select o.sensor, o.seq, o.k, e.init, case when e.init <> 0 then trunc((1e0 - 0.005e0) * e.off::double + 0.005e0 * o.diff::double)::bigint else e.off end from ema e join ord o on o.sensor = e.sensor and o.k = e.k + 1)
     select sensor, seq, off as "offset" from ema"""
    ),
)
def clock_offset_ema(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select((C("event_id") % 4).alias("sensor"), C("event_id").alias("seq"))
    rows = e.withColumns({"raw_ns": 1700000000000000000 + 30000000000 * C("sensor") + (C("seq") * 7919) % 50000000, "ref_ns": F.lit(1700000000000000000)})
    return tm.clock_offsets(rows)


ORACLES["clock_offset_ema"] = ORACLES["clock_offset_ema"].replace("with recursive \n,", "with recursive ").replace("with recursive ,", "with recursive ")


@query("clock_ref_asof", _sql(", st as (select ts_ns, ts_ns - 20000000000 + (seq % 5) * 700000 as got from imu) select frame_id, coalesce((select arg_max(ts_ns, got) from st where got <= recv_ts_ns), recv_ts_ns) as ref_ns from frames", "imu", "frames"))
def clock_ref_asof(spark: SparkSession, sf: str) -> DataFrame:
    stamps = fx.imu(spark, sf).select("ts_ns", (C("ts_ns") - 20000000000 + (C("seq") % 5) * 700000).alias("recv_ts_ns"))
    return tm.clock_reference(fx.frames(spark, sf), stamps)


@query(
    "tf_lookup",
    _sql(_F + _INTERP.format("poses", ", ".join(_MIX.format(c) for c in ("tx", "ty"))).replace("case when p is null then coalesce(b.tx, 0e0)", "case when p is null then b.tx").replace("case when p is null then coalesce(b.ty, 0e0)", "case when p is null then b.ty") + " select frame_id, round(tx, 6) as tx, round(ty, 6) as ty from iv", "poses", "frames"),
)
def tf_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The pose of the moving edge at each frame, and the latest one after the last."""
    return rounded(tm.interpolated(_frames(spark, sf).select("frame_id", "header_ts_ns"), fx.poses(spark, sf), "header_ts_ns", ["tx", "ty"]).select("frame_id", "tx", "ty"))


@query("src_tf_static", "select * from (values ('lidar', 'camera_optical', 0e0, 0e0, 0e0, true), ('camera_link', 'camera_center', 0e0, 0e0, 0.015e0, true), ('camera_center', 'camera_left', -0.01e0, 0.05995845e0, 0e0, true), ('camera_left', 'camera_left_optical', 0e0, 0e0, 0e0, true)) t(parent, child, tx, ty, tz, is_static)")
def src_tf_static(spark: SparkSession, sf: str) -> DataFrame:
    return static_transforms(spark).select("parent", "child", "tx", "ty", "tz", "is_static")


@query("src_tf", _sql("select 'odom' as parent, 'lidar' as child, ts_ns, round(tx, 6) as tx, round(ty, 6) as ty from poses", "poses"))
def src_tf(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tf import moving_transforms

    return rounded(moving_transforms(fx.poses(spark, sf), "odom", "lidar").select("parent", "child", "ts_ns", "tx", "ty"))


@query("tf_tree", "select 'camera_left_optical' as source, 'camera_link' as target, -0.01e0 as tx, 0.05995845e0 as ty, 0.015e0 as tz")
def tf_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A path through three static edges, solved on the driver: the tree has a few rows."""
    m = lookup(static_transforms(spark).collect(), "camera_link", "camera_left_optical")
    return spark.createDataFrame([("camera_left_optical", "camera_link", *(round(float(v), 9) for v in m[:3, 3]))], "source string, target string, tx double, ty double, tz double")


@query("euler_to_matrix", "select round(cos(radians(3e0)) * cos(radians(2e0)), 9) as m00, round(sin(radians(3e0)) * cos(radians(2e0)), 9) as m10, round(-sin(radians(2e0)), 9) as m20, round(cos(radians(2e0)) * sin(radians(-0.4e0)), 9) as m21, round(cos(radians(2e0)) * cos(radians(-0.4e0)), 9) as m22")
def euler_to_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = euler_matrix(-0.4, 2.0, 3.0)
    return spark.createDataFrame([tuple(round(float(m[i]), 9) for i in ((0, 0), (1, 0), (2, 0), (2, 1), (2, 2)))], "m00 double, m10 double, m20 double, m21 double, m22 double")


@query("extrinsic_compose", "select 0e0 as m00, 0e0 as m01, 1e0 as m02, 1e0 as t0 union all select 1e0, 0e0, 0e0, 0e0")
def extrinsic_compose(spark: SparkSession, sf: str) -> DataFrame:
    a, t = extrinsic((0, 0, 1, 1, 0, 0, 0, 1, 0), (1.0, 2.0, 3.0), 0.0, 0.0, 0.0)
    b, u = extrinsic((1.0,), (), 0.0, 0.0, 0.0)
    return spark.createDataFrame([(float(m[0, 0]), float(m[0, 1]), float(m[0, 2]), float(v[0])) for m, v in ((a, t), (b, u))], "m00 double, m01 double, m02 double, t0 double")


_TURN = "select frame_id, point_idx, x, y, z, cos(0.05e0) as c, sin(0.05e0) as s from points"


@query("quat_rotate", _sql(f"select frame_id, point_idx, round((c * c - s * s) * x - 2e0 * s * c * y, 6) as x, round(2e0 * s * c * x + (c * c - s * s) * y, 6) as y, round(z, 6) as z from ({_TURN}) t", "points"))
def quat_rotate(spark: SparkSession, sf: str) -> DataFrame:
    q = (F.lit(0.0), F.lit(0.0), F.sin(F.lit(0.05)), F.cos(F.lit(0.05)))
    x, y, z = rotate(q, (C("x"), C("y"), C("z")))
    return rounded(fx.points(spark, sf).select("frame_id", "point_idx", x.alias("x"), y.alias("y"), z.alias("z")))


@query("rodrigues", _sql("select frame_id, point_idx, round(cos(0.1e0) * x - sin(0.1e0) * y, 6) as x, round(sin(0.1e0) * x + cos(0.1e0) * y, 6) as y, round(z, 6) as z from points", "points"))
def rodrigues_query(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = rodrigues((F.lit(0.0), F.lit(0.0), F.lit(0.1)), (C("x"), C("y"), C("z")))
    return rounded(fx.points(spark, sf).select("frame_id", "point_idx", x.alias("x"), y.alias("y"), z.alias("z")))


@query("nlerp", _sql("select seq, round(a * sin(0.5e0) / sqrt(a * a * sin(0.5e0) * sin(0.5e0) + (1e0 - a + a * cos(0.5e0)) * (1e0 - a + a * cos(0.5e0))), 6) as qz, round((1e0 - a + a * cos(0.5e0)) / sqrt(a * a * sin(0.5e0) * sin(0.5e0) + (1e0 - a + a * cos(0.5e0)) * (1e0 - a + a * cos(0.5e0))), 6) as qw from (select seq, (seq % 101) / 1e2 as a from imu) t", "imu"))
def nlerp_query(spark: SparkSession, sf: str) -> DataFrame:
    zero, one = F.lit(0.0), F.lit(1.0)
    q = nlerp((zero, zero, zero, one), (zero, zero, F.sin(F.lit(0.5)), F.cos(F.lit(0.5))), (C("seq") % 101) / 1e2)
    return rounded(fx.imu(spark, sf).select("seq", q[2].alias("qz"), q[3].alias("qw")))


# ---- motion compensation: frames of the fixture lie 100 ms apart, samples 2.5 ms


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return dk.frame_motion(_frames(spark, sf), fx.edges(spark, sf))


@query("deskew_integrate", moving("select frame_id, ts_ns, 0e0 as qx, round(qy, 6) + 0e0 as qy, 0e0 as qz, round(qw, 6) as qw, round(px, 6) + 0e0 as px, round(py, 6) + 0e0 as py, round(pz, 6) + 0e0 as pz from path"))
def deskew_integrate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dk.trajectories(_frames(spark, sf), _moves(spark, sf), fx.imu(spark, sf)))


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    return dk.deskew_points(fx.points(spark, sf), _frames(spark, sf), _moves(spark, sf), fx.imu(spark, sf))


@query("deskew_points", moving("select frame_id, point_idx, round(nx, 6) + 0e0 as x, round(ny, 6) + 0e0 as y, round(nz, 6) + 0e0 as z, round(moved, 6) as moved from gone"))
def deskew_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_moved(spark, sf).select("frame_id", "point_idx", "x", "y", "z", "moved"))


@query("deskew_metrics", moving("select frame_id, count(moved) as n, round(avg(moved), 6) as avg_m, round(max(moved), 6) as max_m from gone group by frame_id"))
def deskew_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dk.deskew_metrics(_moved(spark, sf)))


@query("frame_motion", moving("select frame_id, t as header_ts_ns, round(vx, 6) as vx, round(vy, 6) as vy, 0e0 as vz, 0e0 as qx, 0e0 as qy, round(sin(yaw / 2e0), 6) + 0e0 as qz, round(cos(yaw / 2e0), 6) as qw, 0.3e0 as lx, 0.05e0 as ly, -0.1e0 as lz from mv"))
def frame_motion(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity, rotation and lever arm by lookups through the transform tree over time."""
    return rounded(_moves(spark, sf))


@query(
    "trajectory_asof",
    _sql(
        """, pt as (select frame_id, point_idx, (timestamp * 1e9)::bigint as t from points),
     lo as (select pt.*, b.ts_ns as p from pt asof left join poses b on pt.t > b.ts_ns),
     nb as (select lo.*, b.ts_ns as n from lo asof left join poses b on lo.t <= b.ts_ns)
     select frame_id, point_idx, round(case when p is null then b.tx when n is null then a.tx else (1e0 - (t - p)::double / (n - p)::double) * a.tx + (t - p)::double / (n - p)::double * b.tx end, 5) as px
     from nb left join poses a on a.ts_ns = p left join poses b on b.ts_ns = n""",
        "points", "poses",
    ),
)
def trajectory_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Position at each point's time, between the poses around it."""
    p = fx.points(spark, sf).select("frame_id", "point_idx", (C("timestamp") * 1e9).cast("long").alias("t_ns"))
    got = tm.interpolated(p, fx.poses(spark, sf), "t_ns", ["tx"])
    return rounded(got.select("frame_id", "point_idx", C("tx").alias("px")), 5)


