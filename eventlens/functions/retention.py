"""Cohort retention: did a group with the anchor event also have the others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import args
from eventlens.functions.events import no_rows


def retention(*conditions: args.ColumnLike) -> Column:
    """Array of booleans, one a condition (2 to 32): the first was true on any row, and so was this one.

    Rows have no order. Null counts as false; without rows the array is empty. Partial
    aggregates are one boolean a condition.
    """
    ever = [F.bool_or(args.truth(c)) for c in args.conditions(conditions)]
    found = F.array(ever[0], *[ever[0] & e for e in ever[1:]])
    return F.when(no_rows(), F.array().cast("array<boolean>")).otherwise(found)
