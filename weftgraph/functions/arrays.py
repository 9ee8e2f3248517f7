"""Array expressions that Spark has no function for, made of those it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(n: Column, join=lambda p, q: p + q) -> Column:
    """Of array<long> n: 0 joined with all before each element, and the whole at the end, in O(n ** 1.5) steps at most.

    Elements are joined in blocks of the square root of their number, so no array grows by one element a step for long.
    """
    none = F.array().cast("array<long>")
    grow = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    start = lambda at: F.struct(at.alias("at"), none.alias("out"))
    whole = lambda x: F.aggregate(x, F.lit(0).cast("long"), join)

    def of(v):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double")))).cast("int")
        return once(size, lambda b: once(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda k: F.slice(v, (k * b + 1).cast("int"), b)), blocks))

    def blocks(parts):
        before = F.aggregate(F.transform(parts, whole), start(F.lit(0).cast("long")), grow, lambda a: F.concat(a["out"], F.array(a["at"])))
        inner = lambda at: F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.slice(at, 1, F.size(parts)).alias("o")), lambda x: F.aggregate(x["p"], start(x["o"]), grow, lambda a: a["out"])))
        return once(before, lambda at: F.concat(inner(at), F.slice(at, -1, 1)))

    return F.when(F.size(n) == 0, F.array(F.lit(0).cast("long"))).otherwise(once(n, of))
