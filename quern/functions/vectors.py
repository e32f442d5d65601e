"""Functions on arrays and bit sets. All are expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row; within functions of arrays an expression is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    """Sum of an array of numbers as a double; 0 of an empty one."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def sign_bits(vector: Column) -> Column:
    """A long with bit i set if component i is positive; for vectors of up to 64 components."""
    picked = F.transform(vector, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.zip_with(picked, F.sequence(F.lit(0), F.size(vector) - 1), lambda b, i: F.call_function("shiftleft", b, i)), F.expr("0L"), lambda a, b: a.bitwiseOR(b))


def bit_tanimoto(a: Column, b: Column) -> Column:
    """Shared bits by all bits of two packed sets; 0 where both are empty."""
    shared, union = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def set_tanimoto(a: Column, b: Column) -> Column:
    """Shared elements by all elements of two arrays taken as sets; 0 where both are empty."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norms > 0, inner_product(a, b) / norms)


def entropy(ps: Column) -> Column:
    """Natural-log entropy of an array of shares."""
    return -total(F.transform(ps, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))


def normalized(xs: Column) -> Column:
    """The array divided by its sum; as it is where the sum is 0."""
    return let(total(xs), lambda s: F.transform(xs, lambda x: F.when(s > 0, x.cast("double") / s).otherwise(x.cast("double"))))


def entropy_weighted(xs: Column) -> Column:
    """Shares of the array; where their entropy S is under 3, raised to 0.25 + 0.25 S. All are normalized again, raised or not."""
    raised = lambda p, s: F.transform(p, lambda x: F.when(x > 0, F.pow(x, 0.25 + 0.25 * s)).otherwise(F.lit(0.0)))
    return let(normalized(xs), lambda p: let(let(entropy(p), lambda s: F.when(s < 3, raised(p, s)).otherwise(p)), normalized))


def stride_sample(xs: Column, n: int) -> Column:
    """n elements at even strides; the whole array where it is no longer."""
    take = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(xs, (F.floor(k * F.size(xs) / n) + 1).cast("int")))
    return F.when(F.size(xs) > n, take).otherwise(xs)


def pair_truncated(a: Column, b: Column) -> Column:
    """Two parallel arrays as an array of (x, y), cut to the shorter; null where either is null."""
    n = F.least(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))


def above_floor(peaks: Column, share: float = 0.002) -> Column:
    """Peaks (x, y) of at least `share` of the largest y; all of them where no y is positive."""
    most = F.array_max(F.transform(peaks, lambda p: p.y))
    return F.when(most > 0, F.filter(peaks, lambda p: p.y >= share * most)).otherwise(peaks)


def strongest(peaks: Column, n: int) -> Column:
    """The n peaks of largest y (ties: smaller x), back in the order of x."""
    ranked = F.array_sort(F.transform(peaks, lambda p: F.struct((-p.y).alias("k"), p.x.alias("x"), p.y.alias("y"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))


def chain_merged(peaks: Column, tol: float) -> Column:
    """Peaks sorted by x; one at most tol from the first x of the run before it joins that run, y summed."""
    start = F.array().cast("array<struct<x:double,y:double>>")
    peak = lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last.x.alias("x"), (last.y + p.y.cast("double")).alias("y"))))
        return F.when((F.size(acc) > 0) & (p.x.cast("double") - F.try_element_at(acc, F.lit(-1)).x <= tol), joined).otherwise(F.concat(acc, F.array(peak(p))))

    def guarded(acc: Column, p: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(peak(p))).otherwise(step(acc, p))

    return F.aggregate(F.array_sort(peaks), start, guarded)


def half_even_bucket(x: Column, width: float, default: float) -> Column:
    """width * round-half-even(x / width); the default for null."""
    return F.coalesce(F.bround(x / width) * width, F.lit(default))
