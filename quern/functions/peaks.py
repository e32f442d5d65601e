"""Similarities of peak lists within a tolerance, for pairs of arrays of (x, y). All are expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.vectors import entropy_weighted, let, total


def _roots(peaks: Column) -> Column:
    return F.transform(peaks, lambda p: F.sqrt(p.y))


def _norm(a: Column, b: Column) -> Column:
    """The product of both lists' lengths as vectors of square roots."""
    return F.sqrt(total(F.transform(a, lambda p: p.y)) * total(F.transform(b, lambda p: p.y)))


def best_peak_cosine(a: Column, b: Column, tol: float) -> Column:
    """Square-root cosine where each peak of a takes its best peak of b within tol; not one-to-one, so it may exceed 1. 0 of an empty list."""
    near = lambda p: F.array_max(_roots(F.filter(b, lambda q: F.abs(p.x - q.x) <= tol)))
    shared = total(F.transform(a, lambda p: F.sqrt(p.y) * F.coalesce(near(p), F.lit(0.0))))
    return F.when(_norm(a, b) > 0, shared / _norm(a, b)).otherwise(F.lit(0.0))


def _candidates(a: Column, b: Column, pairs: Callable[[Column], Column], cost: Callable[[Column, Column, Column], Column]) -> Column:
    """Structs (cost, i, j) of the pairs of peaks whose difference in x counts, in their order."""
    placed = F.transform(b, lambda q, j: F.struct(q.x.alias("x"), q.y.alias("y"), j.alias("j")))
    of = lambda p, i, qs: F.transform(F.filter(qs, lambda q: pairs(p.x - q.x)), lambda q: F.struct(cost(p, q, p.x - q.x).alias("cost"), i.alias("i"), q.j.alias("j")))
    return F.array_sort(let(placed, lambda qs: F.flatten(F.transform(a, lambda p, i: of(p, i, qs)))))


def _one_to_one(candidates: Column) -> Column:
    """(chosen pairs, sum of their costs): in their order, each peak at most once."""
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("i"), none.alias("j"), F.lit(0.0).alias("cost"))

    def take(state: Column, c: Column) -> Column:
        taken = F.array_contains(state.i, c.i) | F.array_contains(state.j, c.j)
        more = F.struct(F.array_append(state.i, c.i).alias("i"), F.array_append(state.j, c.j).alias("j"), (state.cost + c.cost).alias("cost"))
        return F.when(taken, state).otherwise(more)

    return F.aggregate(candidates, start, take)


def modified_cosine(a: Column, b: Column, shift: float, tol: float) -> Column:
    """Cosine of square-rooted heights over one-to-one pairs, direct or moved by the shift, largest products first. 0 of an empty list."""
    near = lambda d: (F.abs(d) <= tol) | (F.abs(d - F.lit(shift)) <= tol)
    chosen = _one_to_one(_candidates(F.array_sort(a), F.array_sort(b), near, lambda p, q, d: -(F.sqrt(p.y) * F.sqrt(q.y))))
    return F.when(_norm(a, b) > 0, -chosen.cost / _norm(a, b)).otherwise(F.lit(0.0))


def _greedy_cosine(a: Column, b: Column, shift: Column | None, tol: float) -> Column:
    """score (at most 1) and matches of one-to-one pairs, largest products first, direct or, beyond the tolerance, moved by the shift."""
    direct = lambda d: F.abs(d) <= tol
    near = direct if shift is None else (lambda d: direct(d) | ((F.abs(shift) > tol) & (F.abs(d - shift) <= tol)))
    chosen = _one_to_one(_candidates(F.array_sort(a), F.array_sort(b), near, lambda p, q, d: -(F.sqrt(p.y) * F.sqrt(q.y))))
    score = lambda c, norm: F.when(norm > 0, F.least(-c.cost / norm, F.lit(1.0))).otherwise(F.lit(0.0))
    made = F.struct(chosen.alias("c"), _norm(a, b).alias("norm"))
    return let(made, lambda m: F.struct(score(m.c, m.norm).alias("score"), F.size(m.c.i).alias("matches")))


def modified_cosines(a: Column, b: Column, a_whole: Column, b_whole: Column, tol: float, margin: float) -> Column:
    """Three cosines of square-rooted heights, each a struct of score and matches: direct pairs alone (direct), also pairs that are
    moved by the difference of the whole values (moved), and the latter without the peaks beyond whole - margin on either side,
    whose heights then don't count in the lengths (lower). A null whole value allows no moved pairs and takes no peak away.

    Lists, whole values and their difference are worked out once a row, not once for each peak or pair of peaks."""
    below = lambda peaks, whole: F.filter(peaks, lambda p: F.coalesce(p.x <= whole - margin, F.lit(True)))
    sides = F.struct(a.alias("a"), b.alias("b"), a_whole.alias("wa"), b_whole.alias("wb"), F.coalesce(a_whole - b_whole, F.lit(0.0)).alias("shift"))
    lower = lambda z: F.struct(below(z.a, z.wa).alias("a"), below(z.b, z.wb).alias("b"), z.shift.alias("shift"))
    return let(
        sides,
        lambda z: F.struct(
            _greedy_cosine(z.a, z.b, None, tol).alias("direct"),
            _greedy_cosine(z.a, z.b, z.shift, tol).alias("moved"),
            let(lower(z), lambda y: _greedy_cosine(y.a, y.b, y.shift, tol)).alias("lower"),
        ),
    )


def closest_matches(a: Column, b: Column, tol: float) -> Column:
    """How many one-to-one pairs within tol there are, the closest taken first."""
    chosen = _one_to_one(_candidates(F.array_sort(a), F.array_sort(b), lambda d: F.abs(d) <= tol, lambda p, q, d: F.abs(d)))
    return F.size(chosen.i)


def _xlnx(v: Column) -> Column:
    return F.when(v > 0, v * F.ln(v)).otherwise(F.lit(0.0))


def tolerance_entropy_similarity(a: Column, b: Column, tol: float) -> Column:
    """Entropy similarity of two weighted lists, walked together: the first peaks left pair if within tol, else the smaller is passed.

    Peaks without a partner cancel in 1 - (2 S(mix) - S(a) - S(b)) / ln 4, so pairs alone add to it. Within 0 and 1.
    """

    def weighted(peaks: Column) -> Column:
        shares = lambda ps: entropy_weighted(F.transform(ps, lambda p: p.y))
        return let(peaks, lambda ps: F.zip_with(ps, shares(ps), lambda p, w: F.struct(p.x.alias("x"), w.alias("w"))))

    at = lambda i, j, s: F.struct(i.alias("i"), j.alias("j"), s.alias("s"))

    def step(z: Column, state: Column) -> Column:
        p, q = F.get(z.left, state.i), F.get(z.right, state.j)
        d = p.x - q.x
        gain = _xlnx(p.w + q.w) - _xlnx(p.w) - _xlnx(q.w)
        paired = at(state.i + 1, state.j + 1, state.s + gain)
        passed = F.when(d < 0, at(state.i + 1, state.j, state.s)).otherwise(at(state.i, state.j + 1, state.s))
        return F.when(p.isNull() | q.isNull(), state).otherwise(F.when(F.abs(d) <= tol, paired).otherwise(passed))

    every = F.sequence(F.lit(0), F.size(a) + F.size(b))
    walk = lambda z: F.aggregate(every, at(F.lit(0), F.lit(0), F.lit(0.0)), lambda state, _: step(z, state), lambda state: state.s)
    lists = F.struct(weighted(F.array_sort(a)).alias("left"), weighted(F.array_sort(b)).alias("right"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), let(lists, walk) / F.ln(F.lit(4.0))))
