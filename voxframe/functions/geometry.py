"""Column expressions of vector geometry: distances, containment, rays, triangles, radius functions.

Every function takes and returns Columns, so that a use stays one codegen projection.
A vector is a tuple of three Columns. Distances are negative inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec(prefix: str = "", names: str = "xyz") -> Vector:
    return tuple(F.col(prefix + c) for c in names)


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def scale(a: Vector, s: Column) -> Vector:
    return tuple(x * s for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector, fallback: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> Vector:
    n = norm(a)
    return tuple(F.when(n > 0, x / n).otherwise(lit(f)) for x, f in zip(a, fallback))


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, lit(hi)), lit(lo))


# distances of a point to a domain

def point_distance(p: Vector, q: Vector) -> Column:
    return norm(sub(p, q))


def box_distance(p: Vector, lo: Vector, hi: Vector) -> Column:
    gap = tuple(F.abs(x - (a + b) * 0.5) - (b - a) * 0.5 for x, a, b in zip(p, lo, hi))
    outside = norm(tuple(F.greatest(g, lit(0)) for g in gap))
    return outside + F.least(F.greatest(*gap), lit(0))


def cylinder_distance(p: Vector, center: tuple[Column, Column], radius: Column, height: Column) -> Column:
    """Axis along y through ``center`` (x, z), y from 0 to ``height``."""
    dx, dz = p[0] - center[0], p[2] - center[1]
    side = F.sqrt(dx * dx + dz * dz) - radius
    cap = F.abs(p[1] - height * 0.5) - height * 0.5
    so, co = F.greatest(side, lit(0)), F.greatest(cap, lit(0))
    return F.sqrt(so * so + co * co) + F.least(F.greatest(side, cap), lit(0))


def plane_distance(p: Vector, origin: Vector, normal: Vector) -> Column:
    return dot(sub(p, origin), normal)


def inside(distance: Column) -> Column:
    """Whether a box or cylinder distance counts as inside."""
    return distance < 1e-4


def in_bounds(p: Vector, lo: Vector, hi: Vector) -> Column:
    out = F.lit(True)
    for x, a, b in zip(p, lo, hi):
        out = out & x.between(a, b)
    return out


def in_oriented_cylinder(p: Vector, base: Vector, axis: Vector, radius: Column, height: Column) -> Column:
    """``axis`` has length one; the ends and the side belong to the cylinder."""
    d = sub(p, base)
    along = dot(d, axis)
    return along.between(lit(0), height) & (norm(sub(d, scale(axis, along))) <= radius)


def in_torus(p: Vector, ring: Column, tube: Column) -> Column:
    """Around the z axis at the origin."""
    r = F.sqrt(p[0] * p[0] + p[1] * p[1]) - ring
    return r * r + p[2] * p[2] < tube * tube


def box_volume(lo: Vector, hi: Vector) -> Column:
    return (hi[0] - lo[0]) * (hi[1] - lo[1]) * (hi[2] - lo[2])


def cylinder_volume(radius: Column, height: Column) -> Column:
    return F.pi() * radius * radius * height


# radius as a function of a distance, each kept between its ends

def linear_radius(d: Column, start: Column, end: Column, reach: Column) -> Column:
    return start + (end - start) * clamp(d / reach, 0, 1)


def quadratic_radius(d: Column, start: Column, end: Column, reach: Column) -> Column:
    t = clamp(d / reach, 0, 1)
    return start + (end - start) * t * t


def smoothstep(t: Column) -> Column:
    return t * t * (lit(3) - t * 2)


def smoothstep_radius(d: Column, start: Column, end: Column, reach: Column) -> Column:
    return start + (end - start) * smoothstep(clamp(d / reach, 0, 1))


def constant_radius(d: Column, start: Column, end: Column, reach: Column) -> Column:
    return start


RADIUS_FUNCTIONS: list[Callable[..., Column]] = [constant_radius, linear_radius, quadratic_radius, smoothstep_radius]


def choose(option: Column, choices: list[Column]) -> Column:
    """``choices[option]`` as a chain of cases; null for any other option."""
    out = F.when(option == 0, choices[0])
    for k, c in enumerate(choices[1:], 1):
        out = out.when(option == k, c)
    return out


# rays and triangles

def ray_meets_box(origin: Vector, direction: Vector, lo: Vector, hi: Vector) -> tuple[Column, Column]:
    """(entry, exit) parameters; no overlap unless entry <= exit and exit >= 0. A ray along a face's plane counts as inside that pair of faces."""
    near, far = [], []
    for o, d, a, b in zip(origin, direction, lo, hi):
        t1, t2 = F.try_divide(a - o, d), F.try_divide(b - o, d)
        parallel_in = o.between(a, b)
        near.append(F.when(d != 0, F.least(t1, t2)).when(parallel_in, lit("-inf")).otherwise(lit("inf")))
        far.append(F.when(d != 0, F.greatest(t1, t2)).when(parallel_in, lit("inf")).otherwise(lit("-inf")))
    return F.greatest(*near), F.least(*far)


def ray_meets_triangle(origin: Vector, direction: Vector, a: Vector, b: Vector, c: Vector, scaled: bool = True) -> Column:
    """Parameter of the hit in front of the origin, or null; borders are hit (Moeller and Trumbore).

    Each share is a ratio of distances to a plane. The planes' normals are scaled to a largest entry of one first, so that
    along the axes nothing is rounded twice, and a place on a border does not fall off it. Rays that keep off
    borders need not be ``scaled``, which is a shorter expression.
    """
    e1, e2 = sub(b, a), sub(c, a)
    p, r, n = cross(direction, e2), cross(e1, direction), cross(e1, e2)
    det, s = dot(e1, p), sub(origin, a)

    def share(normal: Vector, of: Vector) -> Column:
        if scaled:
            size = F.greatest(*(F.abs(x) for x in normal))
            normal = tuple(F.try_divide(x, size) for x in normal)
        return F.try_divide(dot(s, normal), dot(of, normal))

    u, v, t = share(p, e1), share(r, e2), -share(n, direction)
    return F.when((F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-9), t)


def barycentric(p: Vector, a: Vector, b: Vector, c: Vector) -> Vector:
    """Weights of the corners; (1, 0, 0) for a degenerate triangle."""
    v0, v1, v2 = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(v0, v0), dot(v0, v1), dot(v1, v1), dot(v2, v0), dot(v2, v1)
    den = d00 * d11 - d01 * d01
    good = F.abs(den) > 1e-12
    v = F.when(good, F.try_divide(d11 * d20 - d01 * d21, den)).otherwise(lit(0))
    w = F.when(good, F.try_divide(d00 * d21 - d01 * d20, den)).otherwise(lit(0))
    return (lit(1) - v - w, v, w)


def segment_distance(p: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of a point to a segment, in any number of dimensions."""
    ab = [y - x for x, y in zip(a, b)]
    ap = [y - x for x, y in zip(a, p)]
    total = lambda u, v: sum((x * y for x, y in zip(u[1:], v[1:])), u[0] * v[0])
    t = F.coalesce(clamp(F.try_divide(total(ap, ab), total(ab, ab)), 0, 1), lit(0))
    d = [x - y * t for x, y in zip(ap, ab)]
    return F.sqrt(total(d, d))


def triangle_distance(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Distance of a point to a triangle: to its plane over the face, else to the nearest edge."""
    n = cross(sub(b, a), sub(c, a))
    length = norm(n)
    w = barycentric(p, a, b, c)
    over = (length > 1e-12) & (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0)
    plane = F.abs(F.try_divide(dot(sub(p, a), n), length))
    return F.when(over, plane).otherwise(F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, c, a)))


# rotations and metrics; a symmetric matrix is xx, xy, xz, yy, yz, zz

def rotation_about(axis: Vector, angle: Column) -> list[list[Column]]:
    """Rodrigues' rotation about an axis of length one."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    t = lit(1) - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y],
            [t * x * y + s * z, t * y * y + c, t * y * z - s * x],
            [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def rotation_to_x(direction: Vector, roll: Column) -> list[list[Column]]:
    """Rotation that takes ``direction`` to the x axis and then rolls about it.

    The first row is the direction itself; the others follow from the shortest turn, which is
    about z where the direction points along -x.
    """
    x, y, z = unit(direction, (1.0, 0.0, 0.0))
    back = x < -0.999999
    q = F.when(back, lit(0)).otherwise(F.try_divide(lit(1), x + 1))
    second = (-y, F.when(back, lit(-1)).otherwise(lit(1) - y * y * q), -(y * z * q))
    third = (-z, -(y * z * q), lit(1) - z * z * q)
    c, s = F.cos(roll), F.sin(roll)
    return [[x, y, z], [c * u - s * v for u, v in zip(second, third)], [s * u + c * v for u, v in zip(second, third)]]


def multiply(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def apply_matrix(m: list[list[Column]], v: Vector) -> Vector:
    return tuple(m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i in range(3))


def covariance(r: list[list[Column]], s: Vector) -> list[Column]:
    """R^T diag(max(s^2, 1e-6)) R as its six entries."""
    d = [F.greatest(x * x, lit(1e-6)) for x in s]
    entry = lambda i, j: r[0][i] * d[0] * r[0][j] + r[1][i] * d[1] * r[1][j] + r[2][i] * d[2] * r[2][j]
    return [entry(i, j) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def inverse_symmetric(c: list[Column]) -> list[Column]:
    xx, xy, xz, yy, yz, zz = c
    minors = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
    det = xx * minors[0] + xy * minors[1] + xz * minors[2]
    return [F.try_divide(m, det) for m in minors]


def metric_distance_sq(m: list[Column], d: Vector) -> Column:
    xx, xy, xz, yy, yz, zz = m
    return xx * d[0] * d[0] + yy * d[1] * d[1] + zz * d[2] * d[2] + (xy * d[0] * d[1] + xz * d[0] * d[2] + yz * d[1] * d[2]) * 2


def metric_gradient(m: list[Column], d: Vector) -> Vector:
    """M d / |d|_M; zero nearer than 1e-6."""
    xx, xy, xz, yy, yz, zz = m
    n = F.sqrt(metric_distance_sq(m, d))
    rows = (xx * d[0] + xy * d[1] + xz * d[2], xy * d[0] + yy * d[1] + yz * d[2], xz * d[0] + yz * d[1] + zz * d[2])
    return tuple(F.when(n < 1e-6, lit(0)).otherwise(F.try_divide(r, n)) for r in rows)


def candidate_count(kappa: Column, n: Column) -> Column:
    """Neighbours to shortlist before re-ranking by a metric of stretch ratio ``kappa``."""
    return F.least(F.greatest(F.ceil(kappa * kappa * 3), F.least(F.lit(12), n)), n).cast("int")


def smooth_min(a: Column, b: Column, k: Column) -> Column:
    h = F.greatest(k - F.abs(a - b), lit(0)) / k
    return F.least(a, b) - h * h * h * k / 6.0


def smooth_min_weights(a: Column, b: Column, k: Column) -> tuple[Column, Column]:
    """Weights of the gradients of a and b in the gradient of ``smooth_min``."""
    h = F.greatest(k - F.abs(a - b), lit(0)) / k
    m = h * h * 0.5
    return F.when(a < b, lit(1) - m).otherwise(m), F.when(a < b, m).otherwise(lit(1) - m)


def pair_value(a: Column, b: Column) -> Column:
    """Stable number in [0, 1) of an unordered pair of ids."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    # remainders first, so that no id is too large for the products
    lo, hi = F.pmod(lo, F.lit(1000003)), F.pmod(hi, F.lit(1000003))
    return F.pmod(lo * 73856093 + hi * 19349663, F.lit(1000003)) / 1000003.0


def hash_uniform(seed: int, *keys) -> Column:
    """Number in [0, 1) that depends on the keys and the seed only, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)
