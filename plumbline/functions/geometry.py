"""Column functions over rotations (arrays of 9, row-major), translations (arrays of 3) and quaternions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Arguments become lambda variables, so that each is computed once a row.

    Elements of an array written out inline would be copied into every use, and a chain of products would grow
    geometrically while it is planned.
    """

    @wraps(f)
    def call(*args: Column) -> Column:
        def bind(done: tuple, rest: tuple) -> Column:
            if not rest:
                return f(*done)
            return F.get(F.transform(F.array(rest[0]), lambda v: bind((*done, v), rest[1:])), F.lit(0))

        return bind((), args)

    return call


def _at(a: Column, i: int) -> Column:
    return F.get(a, i)


def vector(*values: Column) -> Column:
    return F.array(*values)


@bound
def matmul(a: Column, b: Column) -> Column:
    """3x3 times 3x3."""
    return F.array(*(_at(a, 3 * i) * _at(b, j) + _at(a, 3 * i + 1) * _at(b, 3 + j) + _at(a, 3 * i + 2) * _at(b, 6 + j) for i in range(3) for j in range(3)))


@bound
def transpose(a: Column) -> Column:
    return F.array(*(_at(a, 3 * j + i) for i in range(3) for j in range(3)))


@bound
def apply(a: Column, x: Column) -> Column:
    """3x3 times a vector."""
    return F.array(*(_at(a, 3 * i) * _at(x, 0) + _at(a, 3 * i + 1) * _at(x, 1) + _at(a, 3 * i + 2) * _at(x, 2) for i in range(3)))


@bound
def add(x: Column, y: Column) -> Column:
    return F.array(*(_at(x, i) + _at(y, i) for i in range(3)))


@bound
def sub(x: Column, y: Column) -> Column:
    return F.array(*(_at(x, i) - _at(y, i) for i in range(3)))


@bound
def scale(x: Column, s: Column) -> Column:
    return F.array(*(_at(x, i) * s for i in range(3)))


@bound
def dot(x: Column, y: Column) -> Column:
    return _at(x, 0) * _at(y, 0) + _at(x, 1) * _at(y, 1) + _at(x, 2) * _at(y, 2)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


@bound
def det3(a: Column) -> Column:
    m = [_at(a, i) for i in range(9)]
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def metric_scale(m16: Column) -> Column:
    """Cube root of the absolute determinant of the upper left 3x3 of a 4x4."""
    return F.cbrt(F.abs(det3(F.array(*(_at(m16, 4 * i + j) for i in range(3) for j in range(3))))))


@bound
def left_multiply(m16: Column, p16: Column) -> Column:
    """4x4 times 4x4."""
    cell = lambda i, j: sum((_at(m16, 4 * i + k) * _at(p16, 4 * k + j) for k in range(1, 4)), _at(m16, 4 * i) * _at(p16, j))
    return F.array(*(cell(i, j) for i in range(4) for j in range(4)))


def clipped_acos(c: Column) -> Column:
    """Angle in degrees of a cosine clipped to [-1, 1]."""
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


@bound
def rotation_angle(a: Column, b: Column) -> Column:
    """Angle in degrees between two rotations: trace of a b^T."""
    trace = sum((_at(a, i) * _at(b, i) for i in range(1, 9)), _at(a, 0) * _at(b, 0))
    return clipped_acos((trace - 1) / 2)


@bound
def direction_angle(x: Column, y: Column) -> Column:
    """Angle in degrees between two directions; null where either is shorter than 1e-9."""
    nx, ny = norm(x), norm(y)
    return F.when((nx >= 1e-9) & (ny >= 1e-9), clipped_acos(dot(x, y) / F.nullif(nx * ny, F.lit(0.0))))


def camera_centre(r: Column, t: Column) -> Column:
    """-R^T t."""
    return scale(apply(transpose(r), t), F.lit(-1.0))


def relative_rotation(r_a: Column, r_b: Column) -> Column:
    return matmul(r_b, transpose(r_a))


def relative_translation(r_a: Column, t_a: Column, r_b: Column, t_b: Column) -> Column:
    return sub(t_b, apply(relative_rotation(r_a, r_b), t_a))


@bound
def rotation_of(q: Column) -> Column:
    """Rotation of a unit quaternion (x, y, z, w)."""
    x, y, z, w = (_at(q, i) for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


@bound
def quaternion_of(r: Column) -> Column:
    """Unit quaternion (w, x, y, z) of a rotation, by its largest component, w not negative where it leads."""
    m = [_at(r, i) for i in range(9)]
    half = lambda s: F.sqrt(F.greatest(1 + s, F.lit(0.0))) * 2
    tr = m[0] + m[4] + m[8]
    sw, sx, sy, sz = half(tr), half(m[0] - m[4] - m[8]), half(m[4] - m[0] - m[8]), half(m[8] - m[0] - m[4])
    by = lambda n, s: n / F.nullif(s, F.lit(0.0))
    first = F.array(sw / 4, by(m[7] - m[5], sw), by(m[2] - m[6], sw), by(m[3] - m[1], sw))
    second = F.array(by(m[7] - m[5], sx), sx / 4, by(m[1] + m[3], sx), by(m[2] + m[6], sx))
    third = F.array(by(m[2] - m[6], sy), by(m[1] + m[3], sy), sy / 4, by(m[5] + m[7], sy))
    fourth = F.array(by(m[3] - m[1], sz), by(m[2] + m[6], sz), by(m[5] + m[7], sz), sz / 4)
    return F.when(tr > 0, first).when((m[0] > m[4]) & (m[0] > m[8]), second).when(m[4] > m[8], third).otherwise(fourth)


def pose_vector(r: Column, t: Column) -> Column:
    """A pose as seven numbers: the quaternion (x, y, z, w) of its rotation, then its translation."""
    turned = bound(lambda q: F.array(*(_at(q, i) for i in (1, 2, 3, 0))))(quaternion_of(r))
    return F.concat(turned, t)


def pose_of_vector(p: Column) -> Column:
    """struct(rotation, translation) of seven numbers; the quaternion is taken as it is, of unit length or not."""
    return F.struct(rotation_of(F.slice(p, 1, 4)).alias("rotation"), F.slice(p, 5, 3).alias("translation"))


def apply_similarity(s: Column, r: Column, t: Column, x: Column) -> Column:
    """s R x + t."""
    return add(scale(apply(r, x), s), t)


def pose_in_similarity(s: Column, r: Column, t: Column, r_cw: Column, t_cw: Column) -> Column:
    """struct(rotation, translation) of a camera-from-world pose after its world is moved by a similarity."""
    turned = matmul(r_cw, transpose(r))
    centre = apply_similarity(s, r, t, camera_centre(r_cw, t_cw))
    return F.struct(turned.alias("rotation"), scale(apply(turned, centre), F.lit(-1.0)).alias("translation"))


@bound
def depth_in_camera(r: Column, t: Column, x: Column) -> Column:
    """Third component of R x + t."""
    return _at(r, 6) * _at(x, 0) + _at(r, 7) * _at(x, 1) + _at(r, 8) * _at(x, 2) + _at(t, 2)
