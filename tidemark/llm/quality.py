"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Written
from .hashing import SPACE, as_bytes, prefix_sums, run_hashes, span_hashes, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SHOUTS = np.zeros(256, bool)
SHOUTS[[*range(ord("A"), ord("Z") + 1), ord("!")]] = True

#: A rule's score, from the counts; a text is rejected by a rule if the score is above the stratum's cutoff.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(word_chars, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 20",
}
#: The cutoffs that are tried for each rule, fixed before any label is read.
CUTOFFS = tuple(round(0.05 * i, 2) for i in range(1, 21))
MEASURES = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts"))])


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_shouts (A-Z and !)."""
    data = as_bytes(text)
    starts, ends = word_spans(data)
    if not len(starts):
        return 0, 0, int(SYMBOLS[data].sum()), 0, 0, 0, 0
    sums = prefix_sums(data)
    chars = int((((data & 0xC0) != 0x80) & ~SPACE[data]).sum())
    breaks = np.flatnonzero(data == 0x0A)
    first, last = np.append(0, breaks + 1), np.append(breaks, len(data))
    own = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    lines = int(own.sum())
    distinct = len(np.unique(span_hashes(sums, first[own], last[own])))
    runs = run_hashes(span_hashes(sums, starts, ends), 3)
    repeated = 0
    if len(runs):
        _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
        covered = np.zeros(len(starts), bool)
        for i in range(3):
            covered[i : i + len(runs)] |= counts[back] > 1
        repeated = int(covered.sum())
    return len(starts), chars, int(SYMBOLS[data].sum()), lines - distinct, repeated, lines, int(SHOUTS[data].sum())


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = list(zip(*(measure(t) for t in part["text"].to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["stratum"], *(pa.array(c, pa.int64()) for c in rows)], schema=MEASURES)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string")).mapInArrow(run, from_arrow_schema(MEASURES))


def binomial_bound(failures: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate at confidence 1 - error, from `failures` in n trials."""
    if failures >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(failures + 1)]
    low, high = failures / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        logs = [c + i * math.log(mid) + (n - i) * math.log1p(-mid) for i, c in enumerate(log_choose)] if 0 < mid < 1 else [0.0]
        top = max(logs)
        tail = top + math.log(sum(math.exp(x - top) for x in logs))
        low, high = (mid, high) if tail > math.log(error) else (low, mid)
    return high


def path_of(counts: dict) -> list[tuple[int, float]]:
    """The order in which a stratum's (rule, cutoff) steps are to be tested, from the counts of its tuning half: good, bad and, for each
    rule and cutoff, how many good and bad texts lie above it (g_<rule>_<i>, b_<rule>_<i>). Of each rule, from the most lenient cutoff, those
    stay that reject more of the bad than of the good, by rate, of what the one before let pass; steps of all rules follow by the
    rate of good texts that they reject."""
    steps = []
    for at, rule in enumerate(RULES):
        before = (0.0, 0.0)
        for i, cutoff in reversed(list(enumerate(CUTOFFS))):
            now = counts[f"g_{rule}_{i}"] / max(1, counts["good"]), counts[f"b_{rule}_{i}"] / max(1, counts["bad"])
            if now[1] - before[1] > now[0] - before[0]:
                steps.append((now[0], -cutoff, at, cutoff))
                before = now
    return [(at, cutoff) for *_, at, cutoff in sorted(steps)]


def certified(good: list[int], bad: list[int], limit: float, error: float) -> int:
    """How many steps of a path to take. good, bad: how many held-out texts of each kind go at each step first, and at the end those that
    never go. Steps are tested in their order until the first at which the bound of the rate of good texts gone is above the
    limit, so all tests of a path share one error. Of those that hold, the first is taken up to which the most bad texts less good
    ones have gone, by rate."""
    best, depth, gone, caught = 0.0, 0, 0, 0
    for t in range(len(good) - 1):
        gone, caught = gone + good[t], caught + bad[t]
        if not sum(good) or binomial_bound(gone, sum(good), error) > limit:
            break
        if caught / max(1, sum(bad)) - gone / sum(good) > best + 1e-12:
            best, depth = caught / max(1, sum(bad)) - gone / sum(good), t + 1
    return depth


PATH = T.StructType([T.StructField("stratum", T.StringType()), T.StructField("path", T.ArrayType(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("cutoff", T.DoubleType())])))])
DEPTH = T.StructType([T.StructField("stratum", T.StringType()), T.StructField("depth", T.IntegerType())])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("rule", pa.int32()), ("cutoff", pa.float64())]))
    for batch in batches:
        rows = batch.to_pylist()
        paths = [[{"rule": rule, "cutoff": cutoff} for rule, cutoff in path_of(r)] for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r["stratum"] for r in rows], pa.string()), pa.array(paths, kind)], names=PATH.names)


def certified_paths(rows: DataFrame, keep: Written, limit: float, error: float) -> DataFrame:
    """(stratum, path, depth): the steps of each stratum's path and how many of them hold, for labelled rows(doc_id, stratum, good, scores).

    A hash halves the labelled texts: one half orders the steps, the other tests them. The error is shared evenly among all
    strata (Bonferroni)."""
    tuning = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)) == 0
    rows = keep(rows.withColumn("tuning", tuning), "labelled")
    good, bad = F.col("good"), ~F.col("good")
    score = {rule: F.element_at("scores", i + 1) for i, rule in enumerate(RULES)}
    tally = [F.count_if((good if k == "g" else bad) & (score[rule] > c)).alias(f"{k}_{rule}_{i}") for k in "gb" for rule in RULES for i, c in enumerate(CUTOFFS)]
    counted = rows.where("tuning").groupBy("stratum").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"), *tally)
    paths = keep(counted.mapInArrow(_paths, PATH), "paths")
    held = rows.where("NOT tuning").join(paths, "stratum").select("stratum", "good", step_of(F.col("path"), F.col("scores")).alias("step"))
    steps = held.groupBy("stratum", "step").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    strata = max(1, rows.select("stratum").distinct().count())

    def depth(table: pa.Table) -> pa.Table:
        by = {r["step"]: r for r in table.to_pylist()}
        order = [*range(1, table["steps"][0].as_py() + 1), 0]
        good, bad = ([(by[t][k] or 0) if t in by else 0 for t in order] for k in "gb")
        return pa.table({"stratum": table["stratum"][:1], "depth": pa.array([certified(good, bad, limit, error / strata)], pa.int32())})

    sizes = paths.select("stratum", F.size("path").alias("steps"))
    depths = sizes.join(steps, "stratum", "left").select("stratum", "steps", "step", "g", "b").groupBy("stratum").applyInArrow(depth, DEPTH)
    return paths.join(depths, "stratum")


def step_of(path, scores):
    """The first step of the path that rejects the scores, from 1; 0 if none does."""
    over = F.transform(path, lambda p: F.element_at(scores, p["rule"] + 1) > p["cutoff"])
    return F.array_position(over, True).cast("int")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs(doc_id, text, `stratum`).

    With probability 1 - error, no stratum loses more than `limit` of its good texts (labels.quality 1) that pass the base rules to the
    cutoffs. All labelled texts count; strata with too few to prove a step, or none, keep all that passes the base rules. Null text: no
    words, fails the base. A null stratum is the stratum "". Labels of null ids or values don't count; of several labels
    of an id the smallest counts. Repeated rows each give a row. An empty table gives an empty result."""
    keep = Written(docs.sparkSession)
    base = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    rows = keep(measures(docs, stratum), "measures").withColumn("base_failed", F.expr(base)).withColumn("scores", F.array(*[F.expr(x).cast("double") for x in RULES.values()]))
    truth = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    labelled = rows.where("NOT base_failed").join(truth, "doc_id").select("doc_id", "stratum", "good", "scores")
    plan = keep(certified_paths(labelled, keep, limit, error), "plan")
    keep.only("measures", "plan")
    step = step_of(F.col("path"), F.col("scores"))
    rejected = F.coalesce(step.between(1, F.col("depth")), F.lit(False))
    out = rows.join(plan, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
