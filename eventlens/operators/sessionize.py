"""Sessions by inactivity gap, numbered per row or counted per group."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventlens import args


def _order(partition_by, ts, order_by) -> WindowSpec:
    own = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy()
    return own.orderBy(args.column(ts).asc_nulls_last(), *([args.column(order_by)] if order_by is not None else []))


def _break(ts: Column, order: WindowSpec, gap: dt.timedelta) -> Column:
    """1 at the first event after a longer gap than ``gap``, else 0."""
    return F.when(ts - F.lag(ts).over(order) > F.lit(gap), 1).otherwise(0).cast("long")


def sessionize(
    df: DataFrame, ts: str, gap: dt.timedelta | str | int, partition_by: list[str] | tuple[str, ...] = (),
    name: str = "session_id", order_by: str | None = None, frame: tuple[int, int] | None = None,
) -> DataFrame:
    """``df`` with a session number, from 1, for each row of its partition in order of time.

    A new session begins where more than ``gap`` lies between neighbours. Rows without a
    timestamp have no number and change none. With ``frame`` (row offsets as for
    ``rowsBetween``) the number counts the sessions inside the frame. Both windows share
    one exchange and one sort.
    """
    length, at = args.interval(gap), F.col(ts)
    if length < dt.timedelta(0):
        raise ValueError("a gap can't be negative")
    order = _order(partition_by, ts, order_by)
    flag = f"__{name}_break"
    marked = df.withColumn(flag, _break(at, order, length))
    if frame is None:
        number = 1 + F.sum(flag).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        inside = order.rowsBetween(*frame)
        number = 1 + F.sum(flag).over(inside) - F.first(flag).over(inside)
    return marked.withColumn(name, F.when(at.isNotNull(), number)).drop(flag)


def session_count(df: DataFrame, ts: str, gap, group_by: list[str] | tuple[str, ...] = (), name: str = "sessions") -> DataFrame:
    """Number of sessions of each group; null where no row has a timestamp."""
    length, at = args.interval(gap), F.col(ts)
    marked = df.withColumn("__break", _break(at, _order(group_by, ts, None), length))
    total = F.when(F.count(at) > 0, 1 + F.sum("__break"))
    return marked.groupBy(*group_by).agg(total.alias(name))
