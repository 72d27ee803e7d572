"""Array and map columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtrail.functions.dates import col


def appended(array: Column | str, element: Column | str) -> Column:
    return F.array_append(col(array), col(element))


def total(array: Column | str, kind: str = "long") -> Column:
    return F.aggregate(col(array), F.lit(0).cast(kind), lambda acc, x: acc + x)


def without(array: Column | str, value) -> Column:
    return F.filter(col(array), lambda x: x != F.lit(value))


def head(array: Column | str) -> Column:
    return F.get(col(array), 0)


def tail(array: Column | str) -> Column:
    """Everything but the first element; empty for an empty array."""
    return F.slice(col(array), F.lit(2), F.greatest(F.size(col(array)) - 1, F.lit(0)))


def in_groups(array: Column | str, n: int, separator: str = ",") -> Column:
    """Cut an array into runs of ``n`` and join each with ``separator``, in order.

    The outer lambda binds the array, so it is computed once per row and not once per run.
    """

    def cut(whole: Column) -> Column:
        starts = F.when(F.size(whole) > 0, F.sequence(F.lit(1), F.size(whole), F.lit(n))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda at: F.array_join(F.slice(whole, at, F.lit(n)), separator))

    return F.get(F.transform(F.array(col(array)), cut), 0)


def looked_up(mapping: Column | str, key: Column | str, default) -> Column:
    return F.coalesce(F.try_element_at(col(mapping), col(key)), F.lit(default))
