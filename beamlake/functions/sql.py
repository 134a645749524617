"""The vector and polygon functions as temporary SQL functions of a session; Catalyst inlines them, so they cost what the columns do."""

from __future__ import annotations

from pyspark.sql import SparkSession

_P, _Q, _RING = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>", "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, w: DOUBLE>", "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>>"
_STRUCT = lambda x, y, z: f"named_struct('x', {x}, 'y', {y}, 'z', {z})"
#: name: (parameters, result, body); later ones may use earlier ones.
FUNCTIONS = {
    "v3_add": (f"a {_P}, b {_P}", _P, _STRUCT("a.x + b.x", "a.y + b.y", "a.z + b.z")),
    "v3_sub": (f"a {_P}, b {_P}", _P, _STRUCT("a.x - b.x", "a.y - b.y", "a.z - b.z")),
    "v3_scale": (f"a {_P}, k DOUBLE", _P, _STRUCT("a.x * k", "a.y * k", "a.z * k")),
    "v3_dot": (f"a {_P}, b {_P}", "DOUBLE", "a.x * b.x + a.y * b.y + coalesce(a.z, 0D) * coalesce(b.z, 0D)"),
    "v3_cross": (f"a {_P}, b {_P}", _P, _STRUCT("a.y * coalesce(b.z, 0D) - coalesce(a.z, 0D) * b.y", "coalesce(a.z, 0D) * b.x - a.x * coalesce(b.z, 0D)", "a.x * b.y - a.y * b.x")),
    "v3_norm": (f"a {_P}", "DOUBLE", "sqrt(v3_dot(a, a))"),
    "v3_unit": (f"a {_P}", _P, "CASE WHEN v3_norm(a) > 0 THEN v3_scale(a, try_divide(1D, v3_norm(a))) END"),
    "v3_angle": (f"a {_P}, b {_P}", "DOUBLE", "atan2(v3_norm(v3_cross(a, b)), v3_dot(a, b))"),
    "v3_midpoint": (f"a {_P}, b {_P}", _P, "v3_scale(v3_add(a, b), 0.5D)"),
    "v4_norm2": (f"q {_Q}", "DOUBLE", "q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w"),
    "v4_axis": (f"q {_Q}", _P, _STRUCT("q.x", "q.y", "q.z")),
    "v3_rotate": (
        f"p {_P}, q {_Q}",
        _P,
        "v3_add(v3_add(p, v3_scale(v3_cross(v4_axis(q), p), try_divide(2D * q.w, v4_norm2(q)))), v3_scale(v3_cross(v4_axis(q), v3_cross(v4_axis(q), p)), try_divide(2D, v4_norm2(q))))",
    ),
    "v3_spherical": (f"p {_P}", "STRUCT<azimuth: DOUBLE, elevation: DOUBLE, range: DOUBLE>", "named_struct('azimuth', CASE WHEN v3_norm(p) > 0 THEN atan2(p.y, p.x) END, 'elevation', CASE WHEN v3_norm(p) > 0 THEN atan2(p.z, sqrt(p.x * p.x + p.y * p.y)) END, 'range', v3_norm(p))"),
    "ring_open": (f"r {_RING}", _RING, "CASE WHEN size(r) > 1 AND r[0] = r[size(r) - 1] THEN slice(r, 1, size(r) - 1) ELSE r END"),
    "ring_normal": (
        f"r {_RING}",
        _P,
        "CASE WHEN size(ring_open(r)) >= 3 THEN v3_unit(aggregate(zip_with(ring_open(r), concat(slice(ring_open(r), 2, size(ring_open(r)) - 1), slice(ring_open(r), 1, 1)), (a, b) -> named_struct('x', (a.y - b.y) * (a.z + b.z), 'y', (a.z - b.z) * (a.x + b.x), 'z', (a.x - b.x) * (a.y + b.y))), "
        "named_struct('x', 0D, 'y', 0D, 'z', 0D), (s, t) -> " + _STRUCT("s.x + t.x", "s.y + t.y", "s.z + t.z") + ")) END",
    ),
    "ring_centroid": (f"r {_RING}", _P, "CASE WHEN size(ring_open(r)) > 0 THEN v3_scale(aggregate(ring_open(r), named_struct('x', 0D, 'y', 0D, 'z', 0D), (s, t) -> " + _STRUCT("s.x + t.x", "s.y + t.y", "s.z + t.z") + "), 1D / size(ring_open(r))) END"),
    "line_zenith": (f"n {_P}, a {_P}, b {_P}", "DOUBLE", "CASE WHEN pi() - v3_angle(n, v3_sub(b, a)) <= pi() / 2 THEN pi() - v3_angle(n, v3_sub(b, a)) END"),
    "line_plane_t": (f"p {_P}, d {_P}, on_plane {_P}, n {_P}", "DOUBLE", "try_divide(v3_dot(n, v3_sub(on_plane, p)), v3_dot(n, v3_unit(d)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates all functions in the session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
