"""Helpers for higher-order functions.

Catalyst evaluates an outer expression referenced inside a lambda body once
per element.  ``let`` binds a value once: the value is the argument of a
one-element ``transform`` and the body sees it as a lambda variable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and return ``body(v)``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_rows(df, array_col, alias: str = "_x", keep=(), with_pos: str | None = None):
    """Explode a computed array without the inferred ``size(array) > 0``
    pre-filter: that filter is pushed below the projection and would inline
    (and so re-evaluate) the whole array expression.  ``explode_outer`` gets
    no inferred filter; empty arrays are dropped on the generated column."""
    keep = list(keep)
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(array_col).alias(with_pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    return out.where(F.col(alias).isNotNull())


_CHUNK = 256


def running_starts(gaps: Column, matches: Column) -> Column:
    """0-based start of each match of a text, from the lengths of the gap before
    each match and of the matches (arrays of the same size, not empty).

    The sums run over chunks, so a text with very many matches does not copy a
    growing array for each of them."""
    step = F.zip_with(gaps, matches, lambda g, m: F.struct(g.cast("long").alias("g"), m.cast("long").alias("m")))
    empty = F.expr("array()").cast("array<bigint>")

    def fold(part, start):
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")),
                           lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"),
                                                   F.array_append(acc["out"], acc["at"] + x["g"]).alias("out")),
                           lambda acc: acc["out"])

    def by_part(parts):
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["m"]))
        offsets = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
                              lambda acc, x: F.struct((acc["at"] + x).alias("at"),
                                                      F.array_append(acc["out"], acc["at"]).alias("out")),
                              lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: fold(p, o)))

    def whole(z):
        n = F.ceil(F.size(z) / _CHUNK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(z, i * _CHUNK + 1, _CHUNK)), by_part)

    return let(step, whole)


def first_of_group(sorted_rows: Column, keys) -> Column:
    """The first element of each run of equal ``keys`` in a sorted array of structs."""
    def differs(x, prev):
        out = None
        for k in keys:
            d = ~x[k].eqNullSafe(prev[k])
            out = d if out is None else out | d
        return out
    return let(sorted_rows, lambda s: F.filter(s, lambda x, j: (j == 0) | differs(x, F.get(s, j - 1))))
