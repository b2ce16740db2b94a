"""Events of a group: conditions packed to a mask, collected and sorted.

Events of one timestamp are ordered by the user's order column, if there is one, and
then by mask, so that results never depend on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.args import ColumnLike, column, truth


def mask(conditions: list[Column]) -> Column:
    """The conditions as bits of a long; null is false."""
    total = F.lit(0).cast("long")
    for k, c in enumerate(conditions):
        total = total + F.when(truth(c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def collected(ts: ColumnLike, fields: list[Column], where: Column, order_by: ColumnLike | None) -> Column:
    """Structs of a group, unsorted: ``ts``, the order, then ``fields``. Rows without ts stay away.

    Rows that fail ``where`` become null, which ``collect_list`` passes over before the
    shuffle; a group without such rows has an empty array.
    """
    at = column(ts)
    own = [at.alias("ts"), *([column(order_by).alias("ord")] if order_by is not None else []), *fields]
    return F.collect_list(F.when(where & at.isNotNull(), F.struct(*own)))


def matching(ts: ColumnLike, conditions: list[Column], order_by: ColumnLike | None) -> tuple[Column, Column]:
    """Events that satisfy any condition: the array unsorted and sorted."""
    packed = mask(conditions)
    found = collected(ts, [packed.alias("mask")], packed != 0, order_by)
    return found, F.array_sort(found)


def no_rows() -> Column:
    """True for a group without any row (a global aggregate over nothing)."""
    return F.count(F.lit(1)) == 0
