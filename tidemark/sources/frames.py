"""Tables and files as series(series_id, t, x array<double>), with t dense from 0, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def from_table(df: DataFrame, series_id: str | None, time: str | Sequence[str], values: str | Sequence[str], label: str | None = None) -> DataFrame:
    """Rows ordered by `time` (columns that break ties after the first) within each series; one array column or several numbers as channels."""
    order = [time] if isinstance(time, str) else list(time)
    x = F.col(values).cast("array<double>") if isinstance(values, str) and isinstance(df.schema[values].dataType, T.ArrayType) else F.array(*[F.col(c).cast("double") for c in ([values] if isinstance(values, str) else values)])
    key = F.col(series_id).cast("string") if series_id else F.lit("series")
    out = df.select(key.alias("series_id"), (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("t"), x.alias("x"), *([F.col(label).cast("int").alias("y")] if label else []))
    return out


def regular(df: DataFrame, series_id: str, ts: str, unit: str, value: Column) -> DataFrame:
    """One value for each period of `unit` that has rows, by the aggregate `value`."""
    bins = df.groupBy(F.col(series_id).cast("string").alias("series_id"), F.date_trunc(unit, ts).alias("at")).agg(value.cast("double").alias("v"))
    return from_table(bins, "series_id", "at", "v")


def scaled(series: DataFrame) -> DataFrame:
    """Every channel with mean 0 and deviation 1 within its series; one that doesn't vary is 0."""
    tall = tall_of(series)
    each = W.partitionBy("series_id", "channel")
    sd = F.stddev_pop("value").over(each)
    tall = tall.withColumn("value", F.when(sd > 0, (F.col("value") - F.avg("value").over(each)) / sd).otherwise(0.0))
    return wide_of(tall)


def tall_of(series: DataFrame) -> DataFrame:
    """(series_id, channel, t, value)"""
    return series.select("series_id", "t", F.posexplode("x").alias("channel", "value")).select("series_id", "channel", "t", "value")


def wide_of(tall: DataFrame) -> DataFrame:
    grouped = tall.groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("c"))
    return grouped.select("series_id", "t", F.col("c.value").alias("x"))


def read_csv(spark: SparkSession, path: str, channels: Sequence[str], label: str | None = None, series_id: str | None = None) -> DataFrame:
    """Files without header, a line a time step. The order of lines within a file is that of their offsets: t is taken from the place in
    the file, which only a reader that does not split files knows, so each is read whole. A file is a series, named by its path's end."""
    names = [*channels, *([label] if label else [])]
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("series_id"), F.posexplode(F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"\A\s+|\s+\z", ""), r"\r?\n")).alias("t", "line"))
    cells = lines.select("series_id", F.col("t").cast("long").alias("t"), F.split("line", r"\s*,\s*|\s+").alias("c"))
    out = cells.select(F.lit(series_id).alias("series_id") if series_id else F.col("series_id"), "t", F.transform(F.slice("c", 1, len(channels)), lambda v: v.cast("double")).alias("x"), *([F.element_at("c", len(names)).cast("double").cast("int").alias("y")] if label else []))
    return out


#: Channels of the motion-capture trials.
MOCAP = ("rhumerus_0", "lhumerus_0", "rfemur_0", "lfemur_0")


def read_mocap(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MOCAP, "label")


def write_series(series: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, with a series' rows together and in order of time."""
    series.repartition("series_id").sortWithinPartitions("series_id", "t").write.mode(mode).parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_segments(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Segments (series_id, start, end, state) of labels(series_id, t, state)."""
    segments_of(labels).write.mode(mode).parquet(path)


def segments_of(labels: DataFrame) -> DataFrame:
    by = W.partitionBy("series_id").orderBy("t")
    new = F.when(F.lag("state").over(by) == F.col("state"), 0).otherwise(1)
    runs = labels.withColumn("new", new).withColumn("seg_id", F.sum("new").over(by) - 1)
    return runs.groupBy("series_id", "seg_id").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.min("state").alias("state"))
