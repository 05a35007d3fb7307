"""Schemas of the tables that sources read and sinks write."""

from __future__ import annotations

POINTS = "frame_id bigint, point_idx bigint, x double, y double, z double, intensity double, timestamp double, ring int"
FRAMES = "frame_id bigint, header_ts_ns bigint, recv_ts_ns bigint, sensor_frame string"
IMU = "seq bigint, ts_ns bigint, wx double, wy double, wz double, ax double, ay double, az double"
TF = "parent string, child string, ts_ns bigint, tx double, ty double, tz double, qx double, qy double, qz double, qw double, is_static boolean"
#: Columns of a cluster log, in file order.
CLUSTERS = (
    "frame_id int, cluster_id int, point_count int, x double, y double, z double, range double, bearing double, height double, width_max double, width_min double, "
    "aspect_ratio double, avg_intensity double, linearity double, planarity double, scattering double, verticality double, symmetry double, confidence double, rejection_reason string"
)
PHASES = ("conversion_ms", "deskewing_ms", "ground_removal_ms", "clustering_ms", "merging_ms", "estimation_ms", "duplicate_ms")
PROFILE_FRAME = "frame_id int, " + ", ".join(f"{p} double" for p in PHASES) + ", total_ms double, cones_detected int, deskew_avg_translation_m double, deskew_max_translation_m double"
PROFILE = f"metadata struct<algorithm:string,total_frames:int>, raw_frames array<struct<{PROFILE_FRAME.replace(' double', ':double').replace(' int', ':int').replace(', ', ',')}>>"
