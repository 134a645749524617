"""Polygon functions over exterior rings (array<point>, closed or not) as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from beamlake.functions.vector import add, angle, cross, dot, let, norm, point, scale, sub, two_pi_mod, unit


def opened(ring: Column) -> Column:
    """The ring without a closing point."""
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def normal(ring: Column) -> Column:
    """Unit normal by Newell's sums; null for fewer than three points or no area."""

    def newell(o):
        n = F.size(o)
        at = lambda i: F.element_at(o, (i % n + 1).cast("int"))

        def term(total, i):
            part = lambda a, b: point(total["x"] + (a["y"] - b["y"]) * (a["z"] + b["z"]), total["y"] + (a["z"] - b["z"]) * (a["x"] + b["x"]), total["z"] + (a["x"] - b["x"]) * (a["y"] + b["y"]))
            return let(at(i), lambda a: let(at(i + 1), lambda b: part(a, b)))

        return F.when(n >= 3, unit(F.aggregate(F.sequence(F.lit(0), n - 1), point(0, 0, 0), term)))

    return let(opened(ring), newell)


def centroid(ring: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda o: F.when(F.size(o) > 0, let(F.aggregate(o, point(0, 0, 0), add), lambda s: scale(s, F.lit(1.0) / F.size(o))))
    return let(opened(ring), mean)


def basis(n: Column) -> Column:
    """struct<u, v, n>: a right-handed frame on the plane of normal n; an error for a zero normal."""

    def frame(m):
        steep = F.sqrt(m["x"] * m["x"] + m["y"] * m["y"]) < 0.01
        start = F.when(steep, point(1, 0, 0)).otherwise(point(0, 0, 1))
        u = let(start, lambda a: unit(sub(a, scale(m, dot(a, m)))))
        return let(u, lambda u: F.struct(u.alias("u"), unit(cross(m, u)).alias("v"), m.alias("n")))

    return let(n, lambda n: let(F.coalesce(unit(n), F.when(n.isNotNull(), F.raise_error(F.lit("zero normal")).cast("struct<x:double,y:double,z:double>"))), frame))


def zenith(n: Column, start: Column, end: Column) -> Column:
    """Angle between the incoming line and the normal; null for hits from behind."""
    return let(math.pi - angle(n, sub(end, start)), lambda a: F.when(a <= math.pi / 2, a))


def azimuth(n: Column, on_plane: Column, start: Column, end: Column) -> Column:
    """Direction, on the plane, from the projected line start to the line end, in [0, 2 pi)."""
    foot = lambda n: sub(start, scale(n, dot(sub(start, on_plane), n)))
    turn = lambda n, b: let(sub(end, foot(n)), lambda w: two_pi_mod(F.atan2(dot(w, b["v"]), dot(w, b["u"]))))
    return let(n, lambda m: let(basis(m), lambda b: turn(m, b)))


def uncertainty_segment(start: Column, end: Column, length) -> Column:
    """struct<p0, p1> of the given length along the beam, centred on its end; null for a beam of no length."""
    return let(scale(unit(sub(end, start)), length / 2), lambda h: F.when(h["x"].isNotNull(), F.struct(sub(end, h).alias("p0"), add(end, h).alias("p1"))))


def box_of(points: Column) -> Column:
    field = lambda c: F.transform(points, lambda p: p[c])
    return F.struct(*[f(field(c)).alias(f"{c}{s}") for c in "xyz" for s, f in (("min", F.array_min), ("max", F.array_max))])


def length(a: Column, b: Column) -> Column:
    return norm(sub(b, a))


def midpoint(a: Column, b: Column) -> Column:
    return scale(add(a, b), 0.5)


def make_envelope(lo: Column, hi: Column) -> Column:
    """Box of two corners; null if either is null."""
    fields = [(c + s, p[c]) for s, p in (("min", lo), ("max", hi)) for c in "xyz"]
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(*[v.alias(n) for n, v in fields]))


def box_corners(box: Column) -> Column:
    """The eight corners."""
    return F.array(*[point(box[f"x{a}"], box[f"y{b}"], box[f"z{c}"]) for a in ("min", "max") for b in ("min", "max") for c in ("min", "max")])


def box_volume(box: Column) -> Column:
    return (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"]) * (box["zmax"] - box["zmin"])


def boxes_meet(a: Column, b: Column, grown=0.0) -> Column:
    """Inclusive overlap of two boxes, the first grown on all sides."""
    out = F.lit(True)
    for c in "xyz":
        out = out & (a[f"{c}min"] - grown <= b[f"{c}max"]) & (a[f"{c}max"] + grown >= b[f"{c}min"])
    return out


def is_closed(ring: Column) -> Column:
    return (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def closed(ring: Column) -> Column:
    """The ring with its first point once more at the end."""
    return let(opened(ring), lambda o: F.concat(o, F.slice(o, 1, 1)))


def edges(exterior: Column, holes: Column) -> Column:
    """All edges of a polygon as one array of numbers, six for each edge: what the distance kernel reads."""
    none = F.array().cast("array<array<struct<x:double,y:double,z:double>>>")

    def of_ring(r):
        at = lambda i: F.element_at(r, (i % F.size(r) + 1).cast("int"))
        six = lambda a, b: F.array(*[p[c] for p in (a, b) for c in "xyz"])
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: let(at(i), lambda a: let(at(i + 1), lambda b: six(a, b)))))

    rings = F.concat(F.array(exterior), F.coalesce(holes, none))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: let(opened(r), of_ring)))


def parse_points_wkt(text: Column) -> Column:
    """Points of MULTIPOINT Z or LINESTRING Z text as an array; null for other text."""
    body = F.regexp_extract(F.upper(text), r"^(?:MULTIPOINT|LINESTRING) ?Z ?\((.*)\)$", 1)
    number = lambda s, i: F.element_at(F.split(F.trim(s), r"\s+"), i + 1).cast("double")
    parts = F.split(F.regexp_replace(body, "[()]", ""), ",")
    return F.when(F.length(body) > 0, F.transform(parts, lambda s: point(number(s, 0), number(s, 1), number(s, 2))))
