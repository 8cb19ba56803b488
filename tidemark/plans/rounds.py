"""Statements that are repeated over the open segments of all series at once, a round at a time."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from . import statements as S
from .run import run


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, kept in the folder that driver and executors share."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def binary_segmentation(series: DataFrame, k: int, min_size: int = 2, jump: int = 5) -> DataFrame:
    """(series_id, k, cp): the points of k greedy splits by squared error of series(series_id, t, v bigint). The sums are made once; a round reads
    them and the few open segments."""
    spark = series.sparkSession
    sums = cut(run(spark, S.PREFIX.rstrip().rstrip(",") + "\nSELECT * FROM f", series=series))
    open_ = cut(run(spark, "o AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS s, CAST(n AS BIGINT) AS e, CAST(0 AS BIGINT) AS k FROM {sums})\nSELECT * FROM o", sums=sums))
    for i in range(1, k + 1):
        best = cut(run(spark, S.split_round(min_size, jump), sums=sums, open=open_))
        open_ = cut(run(spark, S.apply_round(i), best=best, open=open_))
    return open_.where("s > 0").select("series_id", "k", open_["s"].alias("cp"))
