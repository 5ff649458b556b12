"""Placement matrices and positions as fixed-size array expressions (row-major 4x4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
IDENTITY = tuple(float(i == j) for i in range(4) for j in range(4))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def identity_matrix() -> Column:
    return F.array(*map(F.lit, IDENTITY))


def matmul(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 arrays."""
    product = lambda x, y: F.array(*(sum((x[4 * i + k] * y[4 * k + j] for k in range(1, 4)), x[4 * i] * y[j]) for i in range(4) for j in range(4)))
    return bound(a, lambda x: bound(b, lambda y: product(x, y)))


def normalised(v: Column) -> Column:
    """Unit vector of three components; vectors under 1e-12 stay as they are."""

    def scaled(x: Column) -> Column:
        norm = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
        return F.when(norm < 1e-12, x).otherwise(F.array(*(x[k] / norm for k in range(3))))

    return bound(v, scaled)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def orthogonalised(x: Column, z: Column) -> Column:
    """x without its part along the unit vector z."""
    dot = x[0] * z[0] + x[1] * z[1] + x[2] * z[2]
    return F.array(*(x[k] - dot * z[k] for k in range(3)))


def axis_placement(location: Column, axis: Column, direction: Column) -> Column:
    """Matrix of a location, its z axis and the direction of x, each possibly null."""
    at = F.coalesce(location, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    along = F.coalesce(direction, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))

    def rows(x: Column, y: Column, z: Column, p: Column) -> Column:
        return F.array(*(c for i in range(3) for c in (x[i], y[i], z[i], p[i])), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    def with_x(z: Column, x: Column) -> Column:
        return bound(cross(z, x), lambda y: bound(at, lambda p: rows(x, y, z, p)))

    up = normalised(F.coalesce(axis, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    return bound(up, lambda z: bound(normalised(bound(along, lambda d: orthogonalised(d, z))), lambda x: with_x(z, x)))


def transformed(m: Column, p: Column) -> Column:
    """A point under a matrix."""
    moved = lambda a, b: F.array(*(a[4 * i] * b[0] + a[4 * i + 1] * b[1] + a[4 * i + 2] * b[2] + a[4 * i + 3] for i in range(3)))
    return bound(m, lambda a: bound(p, lambda b: moved(a, b)))


def quantised_matrix(m: Column) -> Column:
    return F.transform(m, lambda x: F.bround(x * 1e6).cast("long"))


def padded(coordinates: Column) -> Column:
    """Coordinates as three, missing ones 0."""
    return F.array(*(F.coalesce(F.get(coordinates, F.lit(k)), F.lit(0.0)) for k in range(3)))


def delta_mm(old: Column, new: Column) -> Column:
    """Distance of two points in metres as millimetres, three decimals; null if either is."""
    return F.bround(F.sqrt(sum(((new[k] - old[k]) * (new[k] - old[k]) for k in (1, 2)), (new[0] - old[0]) * (new[0] - old[0]))) * 1000, 3)


def compass(dx: Column, dy: Column) -> Column:
    """One of eight directions; y points north and x east."""
    angle = F.degrees(F.atan2(dx, dy))
    angle = F.when(angle < 0, angle + 360).otherwise(angle)
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.bround(angle / 45) % 8 + 1).cast("int"))


def wall_orientation(matrix: Column) -> Column:
    """``<direction>-facing`` of a wall that runs along its local x axis; null without a horizontal direction."""
    nx, ny = -matrix[4], matrix[0]
    return F.when(F.sqrt(nx * nx + ny * ny) >= 0.001, F.concat(compass(nx, ny), F.lit("-facing")))


def format_distance(mm: Column) -> Column:
    m = mm / 1000.0
    return F.when(m < 0.01, F.concat(F.bround(mm).cast("long").cast("string"), F.lit("mm"))).when(m < 1, F.format_string("%.2fm", m)).otherwise(F.format_string("%.1fm", m))


def describe_move(dx: Column, dy: Column, dz: Column) -> Column:
    """Words for a displacement in millimetres."""
    flat = F.sqrt(dx * dx + dy * dy)
    way = F.when(dz > 0, "up").otherwise("down")
    vertical = F.concat(format_distance(F.abs(dz)), F.lit(" "), way)
    level = F.concat(F.lit("moved "), format_distance(flat), F.lit(" "), compass(dx, dy))
    level = F.when(F.abs(dz) >= 100, F.concat(level, F.lit(", "), vertical)).otherwise(level)
    return F.when(flat >= 1, level).when(F.abs(dz) >= 1, F.concat(F.lit("moved "), vertical)).otherwise("placement changed (negligible shift)")


def position_metres(matrix: Column) -> Column:
    """Struct x, y, z of a matrix in millimetres, in metres with two decimals."""
    return F.when(matrix.isNotNull(), F.struct(*(F.bround(matrix[4 * i + 3] / 1000, 2).alias(n) for i, n in enumerate("xyz"))))


def describe_position(matrix: Column) -> Column:
    return F.format_string("at (%.1f, %.1f, %.1f)m", matrix[3] / 1000, matrix[7] / 1000, matrix[11] / 1000)
