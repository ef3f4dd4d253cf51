"""Column functions on scalars and on vectors held as arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _v(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def scaled(a: ColumnLike, factor: Column | float) -> Column:
    factor = _v(factor)
    return F.transform(_c(a), lambda x: x * factor)


def added(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def outer(a: ColumnLike, b: ColumnLike) -> Column:
    """Rows of the outer product."""
    b = _c(b)
    return F.transform(_c(a), lambda x: F.transform(b, lambda y: x * y))


def soft_threshold(x: ColumnLike, most: Column | float) -> Column:
    """Moves a scalar towards 0 by `most`, and to 0 at nearest."""
    x = _c(x)
    return F.signum(x) * F.greatest(F.abs(x) - _v(most), F.lit(0.0))


def group_soft_threshold(a: ColumnLike, most: Column | float) -> Column:
    """Shortens a vector by `most`; a vector that is not longer becomes 0."""
    shrink = F.greatest(F.lit(1.0) - _v(most) / F.nullif(norm(a), F.lit(0.0)), F.lit(0.0))
    return scaled(a, F.coalesce(shrink, F.lit(0.0)))


def box_clip(x: ColumnLike, bound: Column | float) -> Column:
    bound = _v(bound)
    return F.greatest(-bound, F.least(bound, _c(x)))


def ball_clip(a: ColumnLike, radius: Column | float) -> Column:
    """The nearest vector of length at most `radius`."""
    return scaled(a, F.coalesce(F.least(F.lit(1.0), _v(radius) / F.nullif(norm(a), F.lit(0.0))), F.lit(1.0)))


def gaussian_weight(a: ColumnLike, b: ColumnLike, scale: float = 20.0) -> Column:
    return F.exp(-F.pow((_c(a) - _c(b)) / F.lit(scale), F.lit(2.0)))


def noise_floor(x: ColumnLike, floor: float = 1e-10, keep_negative: bool = True) -> Column:
    """Values below the floor become 0. By default the magnitude counts; otherwise every negative value goes too."""
    x = _c(x)
    return F.when((F.abs(x) if keep_negative else x) < floor, F.lit(0.0)).otherwise(x)


def binary(x: ColumnLike, above: float = 0.1) -> Column:
    return (_c(x) > above).cast("int")


def linspace(first: float, last: float, count: int) -> Column:
    """An array of evenly spaced values, both ends included."""
    step = (last - first) / max(1, count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.lit(float(first)) + k * F.lit(step))


def hash_uniform(i: ColumnLike, j: ColumnLike = None, seed: int = 0) -> Column:
    """A number in [0, 1) by integer arithmetic that every engine repeats exactly."""
    i, j = _c(i).cast("long"), (_c(j) if j is not None else F.lit(0)).cast("long")
    return ((i * 7919 + j * 104729 + F.lit(seed).cast("long") * 15485863) % 1000003) / F.lit(1000003.0)


def hash_normal(i: ColumnLike, j: ColumnLike = None, seed: int = 0) -> Column:
    """A standard normal number from two hash_uniform ones (Box and Muller)."""
    u, v = hash_uniform(i, j, 2 * seed), hash_uniform(j if j is not None else F.lit(1), i, 2 * seed + 1)
    return F.sqrt(-2.0 * F.log1p(-u)) * F.cos(F.lit(6.283185307179586) * v)


def _nonzero(x: Column) -> Column:
    return F.when(x != 0.0, x)


def dense_inverse_term(g: list[Column], m: list[list[Column]]) -> Column:
    """g' M^-1 g for up to three regressors, null where M is singular."""
    if len(g) == 1:
        return g[0] * g[0] / _nonzero(m[0][0])
    if len(g) == 2:
        det = m[0][0] * m[1][1] - m[0][1] * m[0][1]
        return (g[0] * g[0] * m[1][1] - 2 * g[0] * g[1] * m[0][1] + g[1] * g[1] * m[0][0]) / _nonzero(det)
    a, b, c, d, e, f = m[0][0], m[0][1], m[0][2], m[1][1], m[1][2], m[2][2]
    minors = (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)
    det = a * minors[0] + b * minors[1] + c * minors[2]
    top = g[0] * g[0] * minors[0] + g[1] * g[1] * minors[3] + g[2] * g[2] * minors[5]
    return (top + 2 * (g[0] * g[1] * minors[1] + g[0] * g[2] * minors[2] + g[1] * g[2] * minors[4])) / _nonzero(det)
