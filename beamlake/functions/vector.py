"""Vector, quaternion and angle functions as Column builders; points are struct<x,y,z>, quaternions struct<x,y,z,w>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value computed once: nested builders would otherwise repeat their arguments without end."""
    return F.element_at(F.transform(F.array(value), f), 1)


def point(x, y, z) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))).cast("double")
    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"), as_double(z).alias("z"))


def sub(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def scale(a: Column, k) -> Column:
    return point(a["x"] * k, a["y"] * k, a["z"] * k)


def _z(a: Column) -> Column:
    return F.coalesce(a["z"], F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + _z(a) * _z(b)


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * _z(b) - _z(a) * b["y"], _z(a) * b["x"] - a["x"] * _z(b), a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Null for the zero vector."""
    of = lambda v, n: F.when(n > 0, point(F.try_divide(v["x"], n), F.try_divide(v["y"], n), F.try_divide(v["z"], n)))
    return let(a, lambda v: let(norm(v), lambda n: of(v, n)))


def angle(a: Column, b: Column) -> Column:
    """Between two vectors, in [0, pi]."""
    turn = lambda u, v: F.when(u.isNotNull() & v.isNotNull(), F.atan2(let(cross(u, v), norm), dot(u, v)))
    return let(a, lambda u: let(b, lambda v: turn(u, v)))


def rotate(p: Column, q: Column) -> Column:
    """p turned by q, which is normalised first; a zero quaternion is an error, a null point stays null."""

    def turned(p, q):
        n2 = q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]
        n = F.when(n2 > 0, F.sqrt(n2)).when(n2.isNotNull(), F.raise_error(F.lit("zero quaternion")).cast("double"))

        def unit_turn(n):
            u, w = point(F.try_divide(q["x"], n), F.try_divide(q["y"], n), F.try_divide(q["z"], n)), F.try_divide(q["w"], n)
            return let(u, lambda u: let(scale(cross(u, p), 2.0), lambda t: add(add(p, scale(t, w)), cross(u, t))))

        return F.when(p.isNotNull(), let(n, unit_turn))

    return let(p, lambda a: let(q, lambda b: turned(a, b)))


def conjugate(q: Column) -> Column:
    return F.struct((-q["x"]).alias("x"), (-q["y"]).alias("y"), (-q["z"]).alias("z"), q["w"].alias("w"))


def spherical(p: Column) -> Column:
    """struct<azimuth, elevation, range>; the origin has no angles."""
    return let(p, lambda v: let(norm(v), lambda r: _spherical(v, r)))


def _spherical(p: Column, r: Column) -> Column:
    return F.struct(
        F.when(r > 0, F.atan2(p["y"], p["x"])).alias("azimuth"),
        F.when(r > 0, F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("elevation"),
        r.alias("range"),
    )


def slerp(a: Column, b: Column, t: Column, degenerate: str = "null") -> Column:
    """Spherical interpolation along the shorter arc.

    Equal orientations give a; nearly equal ones (sine below 1e-6) give null, or a with degenerate="q1"."""

    def between(a, b, raw):
        sign, d = F.when(raw < 0, -1.0).otherwise(1.0), F.abs(raw)
        theta = F.acos(F.least(d, F.lit(1.0)))
        s = F.sqrt(F.greatest(1 - d * d, F.lit(0.0)))
        ka, kb = F.try_divide(F.sin((1 - t) * theta), s), F.try_divide(F.sin(t * theta), s) * sign
        mixed = F.struct(*[(a[c] * ka + b[c] * kb).alias(c) for c in "xyzw"])
        size = lambda m: F.sqrt(m["x"] * m["x"] + m["y"] * m["y"] + m["z"] * m["z"] + m["w"] * m["w"])
        out = let(mixed, lambda m: let(size(m), lambda n: F.struct(*[F.when(n > 1e-6, F.try_divide(m[c], n)).otherwise(m[c]).alias(c) for c in "xyzw"])))
        same = F.struct(*[a[c].alias(c) for c in "xyzw"])
        near = same if degenerate == "q1" else F.lit(None)
        return F.when(a.isNull() | b.isNull(), None).when(d >= 1, same).when(s < 1e-6, near).otherwise(out)

    inner = lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    return let(a, lambda p: let(b, lambda q: let(inner(p, q), lambda d: between(p, q, d))))


def line_plane_parameter(p: Column, direction: Column, on_plane: Column, normal: Column) -> Column:
    """Signed distance along the direction from p to the plane; null if they are parallel."""
    return let(unit(direction), lambda d: let(normal, lambda n: F.try_divide(dot(n, sub(on_plane, p)), dot(n, d))))


def two_pi_mod(a: Column) -> Column:
    return F.pmod(a + 2 * math.pi, F.lit(2 * math.pi))
