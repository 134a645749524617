"""Exact 3D distances and box tests between pairs, vectorised over a batch: polygons come as flat arrays of edges (six numbers each).

Coordinates are taken relative to each polygon's first vertex, so that large offsets cost no precision. A polygon's holes are edges like
any other: crossings are counted over all rings, so that a point in a hole is outside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, DoubleType

_KEPT = np.array([[1, 2], [0, 2], [0, 1]])


def _floats(*columns) -> np.ndarray:
    return np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns], axis=1)


class _Polygons:
    """Edges of a batch of polygons: pair of each edge, its ends, first edge of each pair; only pairs with edges."""

    def __init__(self, edges: pa.Array, normal: np.ndarray):
        edges = edges.combine_chunks() if isinstance(edges, pa.ChunkedArray) else edges
        sizes = np.asarray(edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64) // 6
        self.real = np.flatnonzero((sizes > 0) & ~np.isnan(normal).any(axis=1))
        flat = np.asarray(edges.values.to_numpy(zero_copy_only=False), float)
        start = edges.offsets.to_numpy().astype(np.int64)[:-1][self.real]
        size = sizes[self.real]
        end = np.cumsum(size)
        self.first, self.pair = end - size, np.repeat(np.arange(len(size)), size)
        row = (np.arange(int(size.sum())) - self.first[self.pair]) * 6 + start[self.pair]
        six = flat[row[:, None] + np.arange(6)]
        self.origin = six[self.first, :3]
        self.a, self.b = six[:, :3] - self.origin[self.pair], six[:, 3:] - self.origin[self.pair]
        self.n = normal[self.real]
        self.kept = _KEPT[np.abs(self.n).argmax(axis=1)]

    def least(self, per_edge: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(per_edge, self.first) if len(self.first) else per_edge

    def inside(self, p: np.ndarray) -> np.ndarray:
        """Whether points of the plane are in the polygon, by crossings on the plane of the two longer axes."""
        if not len(self.first):
            return np.empty(0, bool)
        x, y = (p[np.arange(len(p)), self.kept[:, i]][self.pair] for i in (0, 1))
        at = np.arange(len(self.pair))
        ax, ay, bx, by = (v[at, self.kept[self.pair, i]] for v in (self.a, self.b) for i in (0, 1))
        over = (ay > y) != (by > y)
        hit = over & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1.0, by - ay) + ax)
        return np.add.reduceat(hit.astype(np.int64), self.first) % 2 == 1

    def edge_distance2(self, p: np.ndarray) -> np.ndarray:
        d, w = self.b - self.a, p[self.pair] - self.a
        t = np.clip((w * d).sum(1) / np.maximum((d * d).sum(1), 1e-30), 0, 1)
        e = w - t[:, None] * d
        return self.least((e * e).sum(1))

    def point_distance(self, p: np.ndarray) -> np.ndarray:
        h = (p * self.n).sum(1)
        return np.where(self.inside(p - h[:, None] * self.n), np.abs(h), np.sqrt(self.edge_distance2(p)))

    def segment_distance(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        hp, hq = (p * self.n).sum(1), (q * self.n).sum(1)
        t = np.where(hp != hq, hp / np.where(hp != hq, hp - hq, 1.0), 0.0)
        through = (hp * hq <= 0) & (hp != hq) & self.inside(p + (q - p) * t[:, None])
        u, v, w = (q - p)[self.pair], self.b - self.a, p[self.pair] - self.a
        A, B, C, D, E = ((x * y).sum(1) for x, y in ((u, u), (u, v), (v, v), (u, w), (v, w)))
        den = A * C - B * B
        s = np.clip(np.where(den > 1e-18, (B * E - C * D) / np.where(den > 1e-18, den, 1.0), 0.0), 0, 1)
        t = np.clip((B * s + E) / np.maximum(C, 1e-30), 0, 1)
        s = np.clip((B * t - D) / np.maximum(A, 1e-30), 0, 1)
        e = w + s[:, None] * u - t[:, None] * v
        edge = self.least((e * e).sum(1))
        for x in (self.a, self.b):  # an edge's end against the segment
            w = x - p[self.pair]
            s = np.clip((w * u).sum(1) / np.maximum(A, 1e-30), 0, 1)
            e = w - s[:, None] * u
            edge = np.minimum(edge, self.least((e * e).sum(1)))
        return np.where(through, 0.0, np.minimum(np.sqrt(edge), np.minimum(self.point_distance(p), self.point_distance(q))))

    def meets(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the polygon and the solid box have a point in common (closed)."""
        l, h, d = lo[self.pair] - self.a, hi[self.pair] - self.a, self.b - self.a
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = np.where(d != 0, l / d, np.where(l <= 0, -np.inf, np.inf)), np.where(d != 0, h / d, np.where(h >= 0, np.inf, -np.inf))
        enter, leave = np.minimum(t0, t1).max(1), np.maximum(t0, t1).min(1)
        outside = ((d == 0) & ((l > 0) | (h < 0))).any(1)
        touched = ~outside & (np.maximum(enter, 0) <= np.minimum(leave, 1))
        out = np.maximum.reduceat(touched, self.first) if len(self.first) else np.empty(0, bool)
        # otherwise the box lies wholly over the inside or the outside: one point of plane and box tells
        corner = np.array([[(i >> k) & 1 for k in range(3)] for i in range(8)], bool)
        at = np.where(corner[None], hi[:, None], lo[:, None])
        side = (at * self.n[:, None]).sum(2)
        pairs = np.array([(i, i | 1 << k) for i in range(8) for k in range(3) if not i >> k & 1])
        s0, s1 = side[:, pairs[:, 0]], side[:, pairs[:, 1]]
        cut = s0 * s1 <= 0
        rows, edge = np.arange(len(lo)), cut.argmax(1)
        c0, c1, e0, e1 = s0[rows, edge], s1[rows, edge], at[rows, pairs[edge, 0]], at[rows, pairs[edge, 1]]
        t = np.where(c0 != c1, c0 / np.where(c0 != c1, c0 - c1, 1.0), 0.0)
        return out | (cut.any(1) & self.inside(e0 + (e1 - e0) * t[:, None]))


def _filled(n: int, where: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    out, none = np.zeros(n, values.dtype), np.ones(n, bool)
    out[where], none[where] = values, False
    return pa.array(out, kind, mask=none)


@arrow_udf(DoubleType())
def _distance(px: pa.Array, py: pa.Array, pz: pa.Array, qx: pa.Array, qy: pa.Array, qz: pa.Array, edges: pa.Array, nx: pa.Array, ny: pa.Array, nz: pa.Array) -> pa.Array:
    shape, p, q = _Polygons(edges, _floats(nx, ny, nz)), _floats(px, py, pz), _floats(qx, qy, qz)
    n = len(p)
    p, q = p[shape.real] - shape.origin, q[shape.real] - shape.origin
    return _filled(n, shape.real, shape.point_distance(p) if (p == q).all() else shape.segment_distance(p, q), pa.float64())


@arrow_udf(BooleanType())
def _meets(lx: pa.Array, ly: pa.Array, lz: pa.Array, hx: pa.Array, hy: pa.Array, hz: pa.Array, edges: pa.Array, nx: pa.Array, ny: pa.Array, nz: pa.Array) -> pa.Array:
    shape, lo, hi = _Polygons(edges, _floats(nx, ny, nz)), _floats(lx, ly, lz), _floats(hx, hy, hz)
    return _filled(len(lo), shape.real, shape.meets(lo[shape.real] - shape.origin, hi[shape.real] - shape.origin), pa.bool_())


def polygon_distance(p0: Column, p1: Column, edges: Column, normal: Column) -> Column:
    """Distance of a segment (of a point, if its ends are equal) to a polygon; null without edges or normal.

    Edges must come from a relation of their own (a join lies between): Spark takes no lambda among a Python function's arguments."""
    return _distance(*[p[c] for p in (p0, p1) for c in "xyz"], edges, *[normal[c] for c in "xyz"])


def polygon_meets_box(box: Column, edges: Column, normal: Column) -> Column:
    return _meets(*[box[f"{c}{s}"] for s in ("min", "max") for c in "xyz"], edges, *[normal[c] for c in "xyz"])
