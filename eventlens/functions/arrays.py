"""Arrow functions over sorted event arrays, for what no expression reaches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Group = dict[str, np.ndarray | list]


def groups(events: pa.ListArray) -> Iterator[Group]:
    """The events of each group: times in microseconds, masks, and other fields as they are."""
    offsets, flat = events.offsets.to_numpy(), events.values
    fields: Group = {}
    for k in range(flat.type.num_fields):
        name, values = flat.type.field(k).name, flat.field(k)
        if pa.types.is_timestamp(values.type):
            values = values.cast(pa.timestamp("us", values.type.tz)).cast(pa.int64())
        if name in ("ts", "mask"):
            fields[name] = values.to_numpy(zero_copy_only=False)
        elif name in ("base", "known"):
            fields[name] = np.asarray(values.to_pylist(), bool)
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield {name: values[a:b] for name, values in fields.items()}


def over_groups(run: Callable[[Group], object], returns: str, events: Column) -> Column:
    """``run`` applied to each group's events, in Arrow batches."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}

    def each(batch: pa.Array) -> pa.Array:
        return pa.array([run(g) for g in groups(batch)], kinds[returns])

    each.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, returns)(events)
