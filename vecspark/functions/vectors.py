"""Expressions on vectors (ARRAY<DOUBLE>) and numbers; everything stays inside the JVM.

A null vector gives null.  Vectors of unequal length give null, as their missing
components are null.  Row conditions that have no number (a zero norm) give null too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norm squares up to here count as a null vector (square root of the double epsilon).
TINY_SQUARE = math.sqrt(2.0**-52)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value, use) -> Column:
    """``use(value)`` with the value worked out once a row, not once for each place or component that uses it."""
    return F.get(F.transform(F.array(_col(value)), use), F.lit(0))


def total(v) -> Column:
    """Sum of the components."""
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Inner product."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def vec_norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(total(F.transform(_col(v), lambda x: x * x)))


def vec_add(a, b) -> Column:
    """Component-wise sum."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def vec_subtract(a, b) -> Column:
    """Component-wise difference."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def euclidean_distance(a, b) -> Column:
    """Distance of two points."""
    return F.sqrt(total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))))


def unit(x: Column) -> Column:
    """A cosine within [-1, 1] in spite of rounding."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def angle_between(a, b) -> Column:
    """Angle in radians; null where a vector has length 0."""
    size = vec_norm(a) * vec_norm(b)
    return F.when(size > 0, F.acos(unit(dot(a, b) / size)))


def unit_normalize(v) -> Column:
    """Vector of length 1; null where the length is about 0 (1e-12)."""
    return bound(v, lambda v: bound(vec_norm(v), lambda size: F.when(size > 1e-12, F.transform(v, lambda x: x / size))))


def log_base(x, base) -> Column:
    """Logarithm to a base; null unless x > 0, base > 0 and base is not 1."""
    x, base = _col(x), _col(base)
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def log2p1(v) -> Column:
    """log2(x + 1) of a vector's components; null for components of -1 or less."""
    return F.transform(_col(v), lambda x: F.when(x > -1, F.log2(x + 1)))


def rms_normalize(v) -> Column:
    """Vector over the root of its mean square; a zero vector stays."""
    rms = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v))
    return bound(v, lambda v: bound(rms(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)))


def clamp(x, low, high) -> Column:
    """x within [low, high]; low if high < low."""
    return F.greatest(_col(low), F.least(_col(x), _col(high)))


def is_close(a, b, eps: float = 2.0**-52) -> Column:
    """Equal up to relative ``eps`` or absolute 1e-12; non-finite values must be equal."""
    a, b = _col(a), _col(b)
    finite = is_finite(a) & is_finite(b)
    near = F.abs(a - b) <= F.greatest(eps * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    return F.when(finite, near).otherwise((a == b) & ~F.isnan(a) & ~F.isnan(b))


def is_finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def above(x, bound) -> Column:
    """Strictly greater, as an exclusive lower bound; false for NaN."""
    return (_col(x) > _col(bound)) & ~F.isnan(_col(x))


def below(x, bound) -> Column:
    """Strictly smaller, as an exclusive upper bound."""
    return _col(x) < _col(bound)


def radians_positive(degrees) -> Column:
    """Degrees as radians in [0, 2 pi)."""
    return F.radians(F.pmod(_col(degrees), F.lit(360.0)))


def select_axes(v, axes: Sequence[int]) -> Column:
    """The components at the given positions (from 0), in that order."""
    return F.array(*(F.get(_col(v), F.lit(k)) for k in axes))


def true_positions(mask, at_most: int | None = None) -> Column:
    """Positions (from 1) of the true components, the first ``at_most`` of them."""
    found = F.array_compact(F.transform(_col(mask), lambda x, k: F.when(x, k + 1)))
    return found if at_most is None else F.slice(found, 1, at_most)


def versatility(v, axes: Sequence[int] | None = None) -> Column:
    """Struct of ``versatility`` (0 uniform, 1 on one axis) and ``angle_deg`` to the space diagonal.

    One axis gives 0 and 0; a null vector (norm square up to 1.5e-8) gives 1 and 90.
    """
    v = _col(v) if axes is None else select_axes(v, axes)
    k = F.size(v)
    square = total(F.transform(v, lambda x: x * x))
    cos = unit(total(v) / (F.sqrt(square) * F.sqrt(k)))
    cos = F.when(F.abs(cos - 1) < 1e-12, 1.0).otherwise(cos)
    none = square <= TINY_SQUARE
    tv = F.when(k == 1, 0.0).when(none, 1.0).otherwise((1 - cos) / (1 - 1 / F.sqrt(k)))
    angle = F.when(k == 1, 0.0).when(none, 90.0).otherwise(F.degrees(F.acos(cos)))
    return F.when(v.isNotNull(), F.struct(tv.alias("versatility"), angle.alias("angle_deg")))


def rap_project(v, axes: Sequence[int] | None = None) -> Column:
    """Projection onto the plane through the origin that is orthogonal to the diagonal of the axes."""
    v = _col(v) if axes is None else select_axes(v, axes)
    return bound(v, lambda v: bound(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean)))


def rap_project_field(minuend, subtrahend, axes: Sequence[int] | None = None) -> Column:
    """Projection of ``minuend - subtrahend``."""
    return rap_project(vec_subtract(minuend, subtrahend), axes)


def clock_hand_angle(a, b, normal: Sequence[float] | None = None, axes: Sequence[int] = (0, 1, 2)) -> Column:
    """Signed angle (radians) from unit vector a to unit vector b of a projection plane.

    Two axes: the determinant's sign (0 counts as positive).  Three and more: the sign of
    the triple product of a, b and ``normal`` over three ``axes`` (0 counts as positive);
    without a normal, as two vectors alone have no orientation, positive.  One axis: positive.
    """

    def signed(a: Column, b: Column) -> Column:
        det = lambda i, j: F.get(a, F.lit(i)) * F.get(b, F.lit(j)) - F.get(a, F.lit(j)) * F.get(b, F.lit(i))
        turn = F.when(F.size(a) == 2, det(0, 1))
        if normal is not None:
            i, j, k = axes
            x, y, z = map(float, normal)
            turn = turn.when(F.size(a) > 2, det(j, k) * x + det(k, i) * y + det(i, j) * z)
        return F.acos(unit(dot(a, b))) * F.when(turn < 0, -1.0).otherwise(1.0)

    return bound(a, lambda a: bound(b, lambda b: signed(a, b)))


def axis_contributions(v) -> Column:
    """Each component's share of the sum of absolute values.

    Null where that sum is below 1e-8 or a component is not finite.
    """

    def shares(size: Column) -> Column:
        fine = F.forall(_col(v), lambda x: is_finite(x)) & (size >= 1e-8)
        return F.when(fine, F.transform(_col(v), lambda x: F.abs(x) / size))

    return bound(total(F.transform(_col(v), lambda x: F.abs(x))), shares)


def rounded(v, digits: int = 6) -> Column:
    """Components rounded, with -0 as 0."""
    return F.transform(_col(v), lambda x: F.round(x, digits) + F.lit(0.0))
