"""A mix of sources at target weights, cut at exact token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Written, n_words, parts, unused

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes(source, source_size), one row a source, with target: `share` of all sizes by weight, none above
    `most` times its source's size; the excess goes to the others by weight.

    The filling level comes from one ordered pass: sources fill up in the order of limit / weight, and a source is full
    if at the level that the sources after it would reach together its own limit is not above its part."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole, upto, rest = W.partitionBy(), order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("_all", share * F.sum("source_size").over(whole)).withColumn("_full", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))).withColumn("_left", F.sum("_w").over(rest))
    rows = rows.withColumn("_level", F.when(F.col("_cap") * F.col("_left") > (F.col("_all") - F.col("_full")) * F.col("_w"), (F.col("_all") - F.col("_full")) / F.col("_left")))
    rows = rows.withColumn("_at", F.first("_level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 7, rows_each: int = 2_000) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken.

    Within its source a row has a place given by a hash of its id and the seed. Each source's budget is its
    target without the fraction. It takes whole epochs while the budget allows one, and the rest in hash order: rows
    before the cut whole, the row at the cut in part, so that the words taken equal the budget. A slice of the hash range of
    one source, not the source, is what a task orders; slice totals give the prefix sums up to a slice.
    Null text: size 0, never taken. Null sources form one source, the last. Rows of null ids have the hash of their text. Ties of the
    hash stand in the order of id, size and text, so that only rows equal in all of these are interchangeable and a rerun gives the
    same rows however the table is dealt. An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    keep = Written(spark)
    body = F.xxhash64("text")
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), body)))
    rows = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"), body.alias("_body")), "sizes")
    slices = parts(rows.count(), rows_each)
    rows = rows.withColumn("_slice", F.least(F.lit(slices - 1), F.floor((F.col("_key") / F.lit(2.0**64) + 0.5) * slices)).cast("long"))
    cells = keep(rows.groupBy("source", "_slice").agg(F.sum("size").alias("_cell")), "cells")
    aims = targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, share, most)
    before = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = before.alias("b").join(aims.alias("a"), F.expr("b.source <=> a.source")).select("b.source", "_slice", "_before", "source_size", "target")
    rows = rows.withColumn("_sum", F.sum("size").over(W.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", "_body").rowsBetween(W.unboundedPreceding, -1)))
    out = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source and r._slice = p._slice"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_before") - F.coalesce("_sum", F.lit(0))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: each row once per whole epoch that takes it, and a copy cut after
    the words it still gives where its last turn is partial. Rows are matched by doc_id, text and source; of rows equal in these
    each copy keeps its own count. n_chars, where there is such a column, follows a cut text. Columns of any names are kept."""
    names = docs.columns
    ident, nth, taken, size, turn = (unused(n, names) for n in ("_id", "_nth", "_taken", "_size", "_turn"))
    body = F.coalesce("text", F.lit(""))
    same = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(body), F.octet_length(body), F.xxhash64("source"))
    place = F.row_number().over(W.partitionBy(ident).orderBy(ident))
    counts = mix(docs.select(same.alias("doc_id"), "text", "source"), **how).where("taken > 0")
    counts = counts.select(F.col("doc_id").alias(ident), F.col("taken").alias(taken), F.col("size").alias(size)).withColumn(nth, place)
    rows = docs.withColumn(ident, same).withColumn(nth, place).join(counts, [ident, nth])
    rows = rows.withColumn(turn, F.explode(F.expr(f"sequence(1L, CAST(({taken} + {size} - 1) DIV {size} AS BIGINT))")))
    words = (F.col(taken) - (F.col(turn) - 1) * F.col(size)).cast("int")
    partial = words < F.col(size)
    pieces = F.split("text", rf"(?<={WORD[:-1]})(?=[\x20\x09-\x0D])")
    rows = rows.withColumn("text", F.when(partial, F.array_join(F.slice(pieces, 1, words), "")).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(partial, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*names)
