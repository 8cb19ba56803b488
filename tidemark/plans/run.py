"""Statements over DataFrames, and as text for another engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def run(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """The statement over DataFrames that stand for its {names}. Unions must not claim a partitioning: Spark 4.1 zips partitions of
    branches that it takes for equally dealt, and gets that wrong for branches with constants or of different counts."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.sql("WITH " + statement.strip(), **{k: v for k, v in tables.items() if "{" + k + "}" in statement})


def composed(statement: str, **inputs: str) -> str:
    """One text in which inputs, statements themselves, are the tables of those names; others are base tables."""
    names = set(re.findall(r"\{(\w+)\}", statement))
    parts = [f"{k} AS (WITH {v.strip()})" for k, v in inputs.items() if k in names]
    text = "WITH " + ",\n".join([*parts, statement.strip()])
    return re.sub(r"\{(\w+)\}", r"\1", text)
