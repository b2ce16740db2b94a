"""What the corpus operators share: table reading, tables that end lineage, the fold rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of these operators spell it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, read by Spark itself (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors see.

    Only where that is unset and the master is of this machine (tests, a laptop) is a
    temporary folder taken; on a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
    return named.rstrip("/")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a folder in the shared one; what is written there goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    files, path = _file_system(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def delete(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing reads any more."""
    for folder in folders:
        files, path = _file_system(spark, folder)
        files.delete(path, True)


class Scratch:
    """Tables that one call of an operator writes and reads again, all below one folder.

    Each ends the lineage of its rows: a lost executor costs the work since the last one.
    Files tell the planner their true size.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder, self.many = spark, new_folder(spark, kind), 0
        self.at: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """``df``, written once."""
        self.many += 1
        folder = f"{self.folder}/{self.many}"
        df.write.parquet(folder)
        read = self.spark.read.schema(df.schema).parquet(folder)
        self.at[id(read)] = folder
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``cut`` returned and that no later plan reads."""
        delete(self.spark, *[self.at.pop(id(t)) for t in tables])


def partitions(spark: SparkSession) -> int:
    """How many partitions the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the documents that no model may learn from."""
    return fold(doc_id) == 2
