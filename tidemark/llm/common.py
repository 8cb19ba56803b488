"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, one of our own if all runs in
    this process; a cluster without it is refused, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """Parquet tables in the shared folder. They cut lineage, survive the loss of executors, and are read with pruning."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # Spark 4.1 zips the partitions of unlike branches otherwise
        self.base = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[tuple[str, str, int]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        self.tables.append((name, f"{self.base}/{self.n}-{name}", self.n))
        df.write.option("compression", "zstd").parquet(self.tables[-1][1])
        return self.spark.read.schema(df.schema).parquet(self.tables[-1][1])

    def only(self, *names: str, since: int = 0) -> None:
        """Deletes the tables written after the first `since`, but for the last of each of the names: those that a plan still to be run
        reads."""
        last = {name: table for table in self.tables for name in [table[0]] if name in names}
        for table in [t for t in self.tables if last.get(t[0]) != t and t[2] > since]:
            self._delete(table)

    def drop(self, name: str) -> None:
        """Deletes the last table of a name, which no plan still to be run reads."""
        self._delete([t for t in self.tables if t[0] == name][-1])

    def _delete(self, table: tuple[str, str, int]) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table[1])
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.remove(table)


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(n_rows: int, each: int, least: int = 1) -> int:
    """How many buckets of about `each` rows hold n_rows; grows in proportion."""
    return max(least, math.ceil(n_rows / each))


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(*cols: Column) -> Column:
    """A long that spreads rows evenly, those with equal values too. Use it on written tables only, whose partitions are fixed."""
    return F.xxhash64(*cols, F.monotonically_increasing_id())
