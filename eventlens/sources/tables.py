"""Event tables from and to files and tables, pruned and filtered at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "table", "jdbc")


def read_events(
    spark: SparkSession, source: str, kind: str = "parquet", *, schema: str | None = None, columns: list[str] | None = None,
    since: str | None = None, until: str | None = None, ts: str = "ts", **options,
) -> DataFrame:
    """Events of a file, folder, glob or table, with the given columns and times only.

    ``since`` (inclusive) and ``until`` (exclusive) are timestamps as text; on columnar
    sources they and the choice of columns reach the scan. Text formats need a ``schema``,
    as it isn't guessed from the data.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"a {kind} source needs a schema")
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    if schema:
        reader = reader.schema(schema)
    if kind == "table":
        df = reader.table(source)
    elif kind == "jdbc":
        df = reader.format("jdbc").option("dbtable", source).load()
    else:
        df = reader.format(kind).load(source)
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since).cast(df.schema[ts].dataType))
    if until is not None:
        df = df.where(F.col(ts) < F.lit(until).cast(df.schema[ts].dataType))
    return df.select(*columns) if columns else df


def write_result(df: DataFrame, target: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    """A result to files or a table."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(FORMATS)}")
    writer = df.write.mode(mode).options(**({"header": True} if kind == "csv" else {}) | options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "table":
        writer.saveAsTable(target)
    elif kind == "jdbc":
        writer.format("jdbc").option("dbtable", target).save()
    else:
        writer.format(kind).save(target)


def write_bucketed(df: DataFrame, table: str, key: list[str], buckets: int, ts: str = "ts") -> None:
    """Events as a table bucketed by user and sorted by time: functions over it need no shuffle."""
    df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key, ts).saveAsTable(table)
