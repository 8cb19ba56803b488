"""Shards of near-equal bytes from ordered atomic groups (minimax contiguous partition)."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Written, parts, row_key

#: Bits of a group's key that each refinement looks at; an opened interval sends the driver at most 2**BITS rows.
BITS = 12


def greedy_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Cuts (end positions) when every shard takes as many items in order as fit; None if more than `shards` are needed."""
    if sizes and max(sizes) > capacity:
        return None
    sums = [0, *accumulate(sizes)]
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        cuts.append(at)
    return cuts if at == len(sizes) else None


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity for which the greedy check succeeds, by binary search, and its cuts."""
    low, high = max([-(-sum(sizes) // shards), *sizes]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, shards, mid) is not None:
            high = mid
        else:
            low = mid + 1
    return high, greedy_cuts(sizes, shards, high)


def _doubtful(known: list[tuple], shards: int, capacity: int) -> set[int]:
    """Positions of the intervals in which the cut of any capacity from the floor up to `capacity` can lie."""
    sums = [0, *accumulate(x[2] for x in known)]
    floor = max(-(-sums[-1] // shards), max(x[4] for x in known))
    found, low, high = set(), 0, 0
    for _ in range(shards):
        first = min(bisect_right(sums, low + floor) - 1, len(known))
        last = min(bisect_right(sums, high + capacity) - 1, len(known))
        low, high = sums[first], sums[min(last + 1, len(known))]
        found.update(range(first, min(last + 1, len(known))))
    return found


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The first key (signed order) of each shard but the first, for groups(key long, size long), one row a group.

    The driver sees intervals of keys, not groups: 2**BITS of them first, as if each were one item. Each round opens
    the few intervals in which a true cut can lie (at most about shards**2), until these hold single groups; then
    the capacity is that of the groups themselves."""
    spans, known = [(-(1 << 63), 64)], []  # (lowest key, free bits); those and size, groups, largest group
    while spans:
        known = [x for x in known if (x[0], x[1]) not in set(spans)]
        for free in {f for _, f in spans}:
            step = max(0, free - BITS)
            runs: list[list[int]] = []
            for low in sorted(low for low, f in spans if f == free):
                if runs and runs[-1][1] + 1 == low:
                    runs[-1][1] += 1 << free
                else:
                    runs.append([low, low + (1 << free) - 1])
            within = F.lit(False)
            for low, high in runs:
                within = within | F.col("key").between(F.lit(low), F.lit(high))
            found = groups.where(within).groupBy(F.shiftright("key", step).alias("k")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("top"))
            known += [(r.k << step, step, r.s, r.n, r.top) for r in found.collect()]
        known.sort()
        if not known:
            return []
        capacity, cuts = smallest_capacity([x[2] for x in known], shards)
        spans = [known[i][:2] for i in sorted(_doubtful(known, shards, capacity)) if known[i][3] > 1 and known[i][1] > 0]
    return [known[c][0] if c < len(known) else (1 << 63) - 1 for c in cuts[:-1]]


def shard(docs: DataFrame, shards: int = 8, rows_each: int = 20_000, text: str = "text") -> DataFrame:
    """All rows with size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot.

    Rows with equal texts form an atomic group; groups are ordered by a hash of the text, and the smallest capacity
    for which a contiguous partition into `shards` parts exists decides the cuts. Null texts count as empty ones
    and so share their group. A group larger than an even share makes its shard that large. Repeated rows stay,
    each with its own slot; ids don't matter to the shard. An empty table gives an empty result; other columns of docs are
    ignored."""
    spark, keep = docs.sparkSession, Written(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key"))
    rows = keep(rows, "rows")
    groups = keep(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = plan_cuts(groups, shards)
    keep.drop("groups")
    placed = F.lit(0)
    for c in cuts:
        placed = placed + (F.col("key") >= F.lit(c)).cast("int")  # a cut after the last group never counts
    salts = parts(rows.count(), rows_each * shards)
    dealt = rows.withColumn("shard", placed).withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(row_key(F.col("doc_id")), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("shard", "_salt").count()
    before = counts.withColumn("_before", F.sum("count").over(W.partitionBy("shard").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("shard", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("shard", "_salt").orderBy("doc_id", "key", "_row")) - 1)
    return ranked.join(before, ["shard", "_salt"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
