"""Vectors as ARRAY<DOUBLE> columns and matrices as ARRAY<ARRAY<DOUBLE>>, by Spark's own array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = lambda: F.lit(0.0)


def each(a: Column, f) -> Column:
    return F.transform(a, f)


def absolute(a: Column) -> Column:
    return each(a, F.abs)


def ceil(a: Column) -> Column:
    return each(a, lambda x: F.ceil(x).cast("double"))


def floor(a: Column) -> Column:
    return each(a, lambda x: F.floor(x).cast("double"))


def trunc(a: Column) -> Column:
    return each(a, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def sqrt(a: Column) -> Column:
    return each(a, F.sqrt)


def negated(a: Column) -> Column:
    return each(a, lambda x: -x)


def reciprocal(a: Column) -> Column:
    """1 / x, infinite for 0."""
    return each(a, lambda x: F.when(x == 0, float("inf")).otherwise(1 / F.when(x != 0, x)))


def combine(a: Column, b: Column | float, f) -> Column:
    """f over both vectors, or a vector and a number; vectors of different lengths raise an error."""
    if not isinstance(b, Column):
        return each(a, lambda x: f(x, F.lit(float(b))))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("vectors differ in length")))


def add(a: Column, b) -> Column:
    return combine(a, b, lambda x, y: x + y)


def subtract(a: Column, b) -> Column:
    return combine(a, b, lambda x, y: x - y)


def multiply(a: Column, b) -> Column:
    return combine(a, b, lambda x, y: x * y)


def divide(a: Column, b) -> Column:
    """Infinite or NaN for a divisor of 0."""
    inf = F.lit(float("inf"))
    zero = lambda x: F.when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan")))
    return combine(a, b, lambda x, y: F.when(y == 0, zero(x)).otherwise(x / F.when(y != 0, y)))


def power(a: Column, p: float) -> Column:
    return each(a, lambda x: x * x if p == 2 else F.pow(x, F.lit(p)))


def complement(a: Column, k: float = 1.0) -> Column:
    return each(a, lambda x: F.lit(k) - x)


def copy(a: Column, offset: int, length: int, left: float = 0.0, right: float | None = None) -> Column:
    """length values from offset on; left and right fill what lies outside."""
    right = left if right is None else right
    return F.transform(F.sequence(F.lit(offset), F.lit(offset + length - 1)), lambda i: F.when(i < 0, left).otherwise(F.coalesce(F.get(a, i), F.lit(right)))) if length > 0 else F.array().cast("array<double>")


def rotated(a: Column, count: int) -> Column:
    """To the left for counts above 0."""
    k = F.pmod(F.lit(count), F.size(a))
    return F.when(F.size(a) == 0, a).otherwise(F.concat(F.slice(a, k + 1, F.size(a)), F.slice(a, 1, k)))


def reflected(a: Column) -> Column:
    """The second half as the mirror of the first."""
    n = F.size(a)
    half = F.floor((n + 1) / 2).cast("int")
    return F.concat(F.slice(a, 1, half), F.reverse(F.slice(a, 1, n - half)))


def total(a: Column) -> Column:
    return F.aggregate(a, ZERO(), lambda s, x: s + x)


def sum_square(a: Column) -> Column:
    return F.aggregate(a, ZERO(), lambda s, x: s + x * x)


def product(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(a, F.lit(1.0), lambda s, x: s * x))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(float("nan"))


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n == 0, 0.0).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def magnitude(a: Column) -> Column:
    return F.sqrt(sum_square(a))


def rms(a: Column) -> Column:
    return F.sqrt(sum_square(a) / F.size(a))


def variance(a: Column) -> Column:
    m = mean(a)
    return F.greatest(sum_square(a) / F.size(a) - m * m, F.lit(0.0))


def stdev(a: Column) -> Column:
    return F.sqrt(variance(a))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once a row: inside a lambda it would be worked out for every element."""
    return F.transform(F.array(value), f)[0]


def mad_mean(a: Column) -> Column:
    return bound(mean(a), lambda m: mean(each(a, lambda x: F.abs(x - m))))


def mad_median(a: Column) -> Column:
    return bound(median(a), lambda m: bound(each(a, lambda x: F.abs(x - m)), median))


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def normalised(a: Column) -> Column:
    return bound(magnitude(a), lambda m: each(a, lambda x: x / m))


def rescaled(a: Column, low: float = 0.0, high: float = 1.0) -> Column:
    def scaled(ends):
        lo, hi = ends["lo"], ends["hi"]
        return each(a, lambda x: F.when(lo == hi, low).otherwise((x - lo) / F.when(lo != hi, hi - lo) * (high - low) + low))

    return bound(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), scaled)


def quantised(a: Column, low: float, high: float, levels: int) -> Column:
    """The nearest of so many even levels from low to high, halves away from zero."""
    step = (high - low) / (levels - 1)
    return each(a, lambda x: F.round((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / step) * step + low)


def differentiated(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == 0, 0.0).otherwise(x - F.get(a, i - 1)))


#: Values summed at once by integrated().
RUN = 64


def integrated(a: Column) -> Column:
    """Sums up to each value: runs of RUN values, whose sums are added up and carried, so the work isn't quadratic in the length but in RUN and the number of runs."""
    def sums(v: Column) -> Column:
        return F.transform(v, lambda _, i: total(F.slice(v, F.lit(1), i + 1)))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / RUN).cast("int"), F.lit(0))), lambda k: F.slice(a, k * RUN + 1, F.lit(RUN)))
    carried = lambda r: bound(F.transform(r, total), lambda t: F.transform(r, lambda v, k: bound(total(F.slice(t, F.lit(1), k)), lambda c: each(sums(v), lambda y: y + c))))
    return F.when(F.size(a) == 0, a).otherwise(F.flatten(bound(runs, carried)))


def appended(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def rounded(a: Column, decimals: int = 0, even: bool = True) -> Column:
    """Halves to the even neighbour, or away from zero."""
    return each(a, lambda x: (F.bround if even else F.round)(x, decimals))


def to_degrees(a: Column) -> Column:
    return each(a, F.degrees)


def to_radians(a: Column) -> Column:
    return each(a, F.radians)


def null_to(a: Column, default: float = 0.0) -> Column:
    """Null elements as a default."""
    return each(a, lambda x: F.coalesce(x, F.lit(default)))


def moved(a: Column, start: int, to: int) -> Column:
    """The element at start taken out and put in at place to of the rest; places outside change nothing."""
    rest = F.concat(F.slice(a, 1, start), F.slice(a, start + 2, F.greatest(F.size(a) - start - 1, F.lit(0))))
    put = F.concat(F.slice(rest, 1, to), F.slice(a, start + 1, 1), F.slice(rest, to + 1, F.greatest(F.size(rest) - to, F.lit(0))))
    return F.when((F.lit(max(start, to)) < F.size(a)) & F.lit(min(start, to) >= 0), put).otherwise(a)


def dequeued(a: Column, count: int) -> Column:
    """A struct of taken, the first count elements (all, if fewer), and left."""
    return F.struct(F.slice(a, 1, count).alias("taken"), F.slice(a, count + 1, F.greatest(F.size(a) - count, F.lit(0))).alias("left"))


def convolved(a: Column, b: Column) -> Column:
    """The product of two polynomials: sums of a[i] b[k - i]."""
    terms = lambda k: F.filter(F.transform(a, lambda x, i: x * F.get(b, k - i)), lambda x: x.isNotNull())
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), lambda k: total(terms(k)))).otherwise(F.array().cast("array<double>"))


def rolling(a: Column, count: int, f) -> Column:
    """f of the values up to count // 2 away on either side."""
    h = count // 2
    return F.transform(a, lambda x, i: f(F.slice(a, F.greatest(i - h, F.lit(0)) + 1, F.least(i + h, F.size(a) - 1) - F.greatest(i - h, F.lit(0)) + 1)))


def equal(a: Column, b: Column, tolerance: float) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))


def wrapped(a: Column, half: float) -> Column:
    """Into -half..half by whole turns."""
    return each(a, lambda x: x - 2 * half * F.round(x / (2 * half)))


def polyval(coefficients: Column, x: Column) -> Column:
    """Highest power first."""
    return F.aggregate(coefficients, ZERO(), lambda s, c: s * x + c)


def cross(a: Column, b: Column) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def radians_between(a: Column, b: Column) -> Column:
    c = dot(a, b) / (magnitude(a) * magnitude(b))
    return F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


def rotated_around(v: Column, axis: Column, radians: Column) -> Column:
    """v turned around an axis by Rodrigues' formula."""
    k = normalised(axis)
    along = dot(k, v)
    kv = cross(k, v)
    return F.transform(v, lambda x, i: x * F.cos(radians) + F.get(kv, i) * F.sin(radians) + F.get(k, i) * along * (1 - F.cos(radians)))


def quaternion_rotated(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion (w, x, y, z)."""
    w, u = F.get(q, F.lit(0)), F.slice(q, 2, 3)
    t = each(cross(u, v), lambda x: 2 * x)
    ut = cross(u, t)
    return F.transform(v, lambda x, i: x + w * F.get(t, i) + F.get(ut, i))


def as_column(a: Column) -> Column:
    return each(a, lambda x: F.array(x))


def as_row(a: Column) -> Column:
    return F.array(a)


def outer(a: Column, b: Column) -> Column:
    return each(a, lambda x: F.transform(b, lambda y: x * y))


def transposed(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def matrix_combine(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, f))


def matrix_product(a: Column, b: Column) -> Column:
    columns = transposed(b)
    return F.transform(a, lambda r: F.transform(columns, lambda c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), ZERO(), lambda s, x: s + x)))


def eye(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(n)]) for i in range(n)])


def frobenius(m: Column) -> Column:
    return magnitude(F.flatten(m))


def determinant_2(m: Column) -> Column:
    g = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    return g(0, 0) * g(1, 1) - g(0, 1) * g(1, 0)


def inverted(m: Column) -> Column:
    """Inverse of square matrices of any size by elimination, the pivot of each step being the row with the greatest element; null for singular ones."""
    g = lambda row, j: F.get(row, j)
    n = F.size(m)
    wide = F.transform(m, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0))))

    def step(state: Column, k: Column) -> Column:
        below = F.transform(F.sequence(k, n - 1), lambda i: F.struct(F.abs(g(g(state, i), k)).alias("v"), (-i).alias("i")))
        at = -F.array_max(below)["i"]

        def swept(pivot: Column) -> Column:
            # Singular where the pivot is 0: division by null makes the whole null.
            top = bound(F.nullif(g(pivot, k), F.lit(0.0)), lambda p: each(pivot, lambda x: x / p))
            rest = lambda t: F.transform(state, lambda row, i: F.when(i == k, t).otherwise(bound(F.when(i == at, g(state, k)).otherwise(row), lambda r: F.zip_with(r, t, lambda x, y: x - g(r, k) * y))))
            return bound(top, rest)

        return bound(g(state, at), swept)

    done = F.aggregate(F.sequence(F.lit(0), n - 1), wide, step)
    out = F.transform(done, lambda row: F.slice(row, n + 1, n))
    return F.when(F.forall(F.flatten(out), lambda x: x.isNotNull()), out)


def polyfit(a: Column, order: int) -> Column:
    """Coefficients, highest power first, of the polynomial of places 0, 1, 2... that fits the values best; null for fewer values than coefficients. For short vectors and low orders, by the normal equations."""
    n, size = F.size(a), order + 1
    power = lambda p: F.transform(a, lambda _, i: F.pow(i.cast("double"), F.lit(float(p))))
    powers = [power(p) for p in range(2 * order + 1)]
    sums = F.array(*[total(p) for p in powers])
    right = F.array(*[F.array(dot(powers[order - i], a)) for i in range(size)])

    def solved(g: Column) -> Column:
        left = F.array(*[F.array(*[F.get(g, F.lit(2 * order - i - j)) for j in range(size)]) for i in range(size)])
        return F.flatten(matrix_product(inverted(left), right))

    return F.when(n >= size, bound(sums, solved))
