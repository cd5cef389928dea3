"""Vector and loss functions as Column expressions over array<double> (F1 to F7). None of them uses Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str


def _col(x: Vector) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Vector) -> Column:
    """Sum of the elements, in order."""
    return F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + v)


def mean(x: Vector) -> Column:
    return total(x) / F.size(_col(x))


def dot(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda u, v: u * v))


def norm(x: Vector) -> Column:
    return F.sqrt(dot(x, x))


def scale(x: Vector, by: Column) -> Column:
    return F.transform(_col(x), lambda v: v * by)


def unit(x: Vector, eps: float = 1e-12) -> Column:
    """x over its L2 norm; a zero vector stays zero."""
    return let(F.greatest(norm(x), F.lit(eps)), lambda n: F.transform(_col(x), lambda v: v / n))


def cosine(a: Vector, b: Vector, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def squared_distance(a: Vector, b: Vector) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda u, v: (u - v) * (u - v)))


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_distance(a, b))


def lerp(a: Vector, b: Vector, t: Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda u, v: u + (v - u) * t)


def slerp(a: Vector, b: Vector, t: Column) -> Column:
    """Along the great circle between the unit vectors of a and b; the result is a unit vector. Parallel ends give a's."""

    def along(ends: Column) -> Column:
        ua, ub = ends["a"], ends["b"]
        cos = let(dot(ua, ub), lambda d: F.greatest(F.least(d, F.lit(1.0)), F.lit(-1.0)))
        side = let(cos, lambda d: unit(F.zip_with(ub, ua, lambda v, u: v - d * u)))
        turn = F.struct((t * F.acos(cos)).alias("angle"), side.alias("side"))
        return let(turn, lambda w: unit(F.zip_with(ua, w["side"], lambda u, s: u * F.cos(w["angle"]) + s * F.sin(w["angle"]))))

    return let(F.struct(unit(a).alias("a"), unit(b).alias("b")), along)


def layer_norm(x: Vector, eps: float = 1e-6) -> Column:

    def scaled(m: Column) -> Column:
        var = total(F.transform(_col(x), lambda v: (v - m) * (v - m))) / F.size(_col(x))
        return let(F.sqrt(var + eps), lambda d: F.transform(_col(x), lambda v: (v - m) / d))

    return let(mean(x), scaled)


def standardise(x: Vector, center: Vector, spread: Vector) -> Column:
    """(x - center) / spread, element by element; where spread is 0 the result is 0."""
    moved = F.zip_with(_col(x), _col(center), lambda v, c: v - c)
    return F.zip_with(moved, _col(spread), lambda v, s: F.when(s == 0, 0.0).otherwise(v / s))


def gather(x: Vector, index: Vector) -> Column:
    """Elements at the given places, from 0."""
    return F.transform(_col(index), lambda i: F.get(_col(x), i.cast("int")))


def repeat_interleave(x: Vector, times: int) -> Column:
    return F.flatten(F.transform(_col(x), lambda v: F.array_repeat(v, times)))


def one_hot(label: Vector, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == _col(label)).cast("double"))


def argmax(x: Vector) -> Column:
    """Place of the largest element, from 0; the first of equals."""
    return (F.array_position(_col(x), F.array_max(_col(x))) - 1).cast("int")


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def softplus(x: Column) -> Column:
    """log(1 + e^x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp(x: Vector) -> Column:
    return let(F.array_max(_col(x)), lambda top: top + F.log(total(F.transform(_col(x), lambda v: F.exp(v - top)))))


def log_softmax(x: Vector) -> Column:
    return let(log_sum_exp(x), lambda lse: F.transform(_col(x), lambda v: v - lse))


def softmax(x: Vector) -> Column:
    return F.transform(log_softmax(x), lambda v: F.exp(v))


def polynomial_kernel(a: Vector, b: Vector) -> Column:
    """(a.b / n + 1)^3 with n the dimension."""
    k = dot(a, b) / F.size(_col(a)) + 1
    return k * k * k


def kl_row(p: Vector, q: Vector) -> Column:
    """Sum of p log(p / q); a zero p adds nothing."""
    return total(F.zip_with(_col(p), _col(q), lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)))
