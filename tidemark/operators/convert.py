"""Between labels, change points, segments and windows, for all series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BY_TIME = W.partitionBy("series_id").orderBy("t")


def change_points(labels: DataFrame, label: str = "state") -> DataFrame:
    """(series_id, cp) of labels(series_id, t, label): the first index of every new state, without the ends."""
    before = F.lag(label).over(BY_TIME)
    return labels.select("series_id", "t", label, before.alias("_b")).where(f"_b IS NOT NULL AND NOT (_b <=> {label})").select("series_id", F.col("t").alias("cp"))


def with_ends(cps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Change points and the ends 0 and n of lengths(series_id, n), each once."""
    ends = lengths.select("series_id", F.explode(F.array(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("cp"))
    return cps.select("series_id", "cp").unionByName(ends).distinct()


def without_ends(cps: DataFrame, lengths: DataFrame) -> DataFrame:
    return cps.join(lengths, "series_id").where("cp > 0 AND cp < n").select("series_id", "cp").distinct()


def state_labels(cps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, t, state): the index of the segment of each time step; points outside (0, n) don't count."""
    steps = lengths.where("n > 0").select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("t"))
    marks = cps.where("cp > 0").select("series_id", F.col("cp").alias("t"), F.lit(1).alias("_m")).distinct()
    return steps.join(marks, ["series_id", "t"], "left").select("series_id", "t", F.coalesce(F.sum("_m").over(BY_TIME), F.lit(0)).cast("int").alias("state"))


def classification(cps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series_id, t, y): 1 at change points, else 0."""
    steps = lengths.where("n > 0").select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("t"))
    marks = cps.select("series_id", F.col("cp").alias("t"), F.lit(1).alias("_m")).distinct()
    return steps.join(marks, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("_m", F.lit(0)).alias("y"))


def labels_of_segments(segments: DataFrame) -> DataFrame:
    """(series_id, t, state) of segments(series_id, start, end, state), half open."""
    return segments.where("end > start").select("series_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("t"), "state")


def expanded(labels: DataFrame, width: int) -> DataFrame:
    """Every label `width` times in a row."""
    steps = labels.select("series_id", F.col("t").alias("_t"), "state", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_k"))
    return steps.select("series_id", (F.col("_t") * width + F.col("_k")).cast("long").alias("t"), "state")


def sliding_windows(series: DataFrame, width: int, stride: int = 1) -> DataFrame:
    """(series_id, t, window): the x of `width` steps from t on, for every stride-th t; windows that would pass the end are left out."""
    ahead = BY_TIME.rowsBetween(0, width - 1)
    out = series.withColumn("window", F.collect_list("x").over(ahead)).where(F.size("window") == width)
    return out.where(F.col("t") % stride == 0).select("series_id", "t", "window")


def by_first_seen(labels: DataFrame) -> DataFrame:
    """States renamed 0, 1, ... in the order in which they first occur in their series."""
    first = labels.groupBy("series_id", "state").agg(F.min("t").alias("_f"))
    names = first.select("series_id", "state", (F.row_number().over(W.partitionBy("series_id").orderBy("_f")) - 1).alias("_n"))
    return labels.join(names, ["series_id", "state"]).select("series_id", "t", F.col("_n").alias("state"))


def interpolated(tall: DataFrame) -> DataFrame:
    """Missing values of series(series_id, channel, t, value) on the line between their neighbours, at the ends the nearest value, 0 where
    there is none; then each channel on [0, 1], a constant one 0."""
    each = W.partitionBy("series_id", "channel")
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    known = F.when(value.isNotNull(), F.struct(F.col("t"), value.alias("v")))
    before, after = each.orderBy("t").rowsBetween(W.unboundedPreceding, 0), each.orderBy("t").rowsBetween(0, W.unboundedFollowing)
    rows = tall.withColumn("_b", F.last(known, True).over(before)).withColumn("_a", F.first(known, True).over(after))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("t") - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    filled = F.coalesce(F.when(F.col("_a.t") == F.col("_b.t"), F.col("_b.v")).otherwise(line), "_b.v", "_a.v", F.lit(0.0))
    rows = rows.withColumn("value", filled)
    low, high = F.min("value").over(each), F.max("value").over(each)
    return rows.withColumn("value", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.0)).select("series_id", "channel", "t", "value")


def vote(windows: DataFrame, lengths: DataFrame, width: int) -> DataFrame:
    """(series_id, t, state): of windows(series_id, start, label) that cover t the most frequent label, the smallest of equals, 0 where none does."""
    points = windows.select("series_id", "label", F.explode(F.sequence("start", F.col("start") + width - 1)).alias("t")).groupBy("series_id", "t", "label").count()
    best = points.groupBy("series_id", "t").agg(F.min(F.struct(-F.col("count"), F.col("label"))).getField("label").alias("label"))
    steps = lengths.where("n > 0").select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("t"))
    return steps.join(best, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("label", F.lit(0)).alias("state"))
