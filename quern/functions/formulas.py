"""Formulas such as C6H12O6: numbers of units, masses and keys, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.vectors import let

# Masses of the most common isotopes.
MASSES = {
    "H": 1.00782503207, "B": 11.0093054, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Na": 22.9897692809, "Si": 27.9769265325, "P": 30.97376163, "S": 31.972071, "Cl": 34.96885268,
    "K": 38.96370668, "Fe": 55.9349375, "Se": 79.9165213, "Br": 78.9183371, "I": 126.904473,
}

_KIND = "array<struct<unit:string,n:bigint>>"


def counted(pairs: Column) -> Column:
    """(unit, n) structs summed by unit, in the order of units, without those of number 0."""
    units = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p.unit)))
    number = lambda ps, u: F.aggregate(F.filter(ps, lambda p: p.unit == u), F.lit(0).cast("long"), lambda total, p: total + p.n)
    summed = let(pairs, lambda ps: F.transform(units, lambda u: F.struct(u.alias("unit"), number(ps, u).alias("n"))))
    return F.filter(summed, lambda p: p.n != 0)


def parsed(formula: Column) -> Column:
    """The formula's units with their numbers, summed by unit; null for a null text or one that is no formula. An empty text has none."""
    parts = F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?[0-9]*"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "[A-Za-z]", "")
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_replace(x, "[0-9]", "").alias("unit"), F.when(digits(x) == "", F.lit(1).cast("long")).otherwise(digits(x).try_cast("long")).alias("n")))
    return F.when(formula.rlike("^([A-Z][a-z]?[0-9]{0,9})*\\z"), counted(pairs.cast(_KIND)))


def mass(units: Column) -> Column:
    """The mass of the units; null where one has none in MASSES."""
    known = F.create_map(*[F.lit(x) for u, m in MASSES.items() for x in (u, m)])
    return F.aggregate(units, F.lit(0.0), lambda total, p: total + p.n * F.try_element_at(known, p.unit))


def key(units: Column) -> Column:
    """The units as one text: carbon, then hydrogen, then the others by name; all by name without carbon. A number of 1 is left out."""
    carbon = F.exists(units, lambda p: p.unit == "C")
    place = lambda p, c: F.when(c & (p.unit == "C"), 0).when(c & (p.unit == "H"), 1).otherwise(2)
    placed = let(carbon, lambda c: F.array_sort(F.transform(units, lambda p: F.struct(place(p, c).alias("place"), p.unit.alias("unit"), p.n.alias("n")))))
    return F.array_join(F.transform(placed, lambda p: F.concat(p.unit, F.when(p.n == 1, "").otherwise(p.n.cast("string")))), "")


def added(a: Column, b: Column) -> Column:
    """The sum of two units' lists; null where a number falls below 0."""
    return let(counted(F.concat(a, b)), lambda s: F.when(~F.exists(s, lambda p: p.n < 0), s))


def changed(units: dict[str, int]) -> Column:
    """A literal list of units, whose numbers may be negative, as operations have."""
    return F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(n).cast("long").alias("n")) for u, n in units.items()]).cast(_KIND)
