"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Written
from .components import components
from .hashing import as_bytes, mix, run_hashes, word_hashes

WORDS, PERCENT = 5, 75
#: Two collections of HALVES half keys, each of DEPTH minhashes. A table for each pair of halves makes HALVES**2 tables out of
#: 2 * HALVES * DEPTH minhashes. At similarity 0.75 a pair shares no table with probability 3e-4, at 0.8 with 2e-5.
HALVES, DEPTH = 16, 3
#: Further stars in buckets that the first star has not joined.
STARS = 1
#: Sizes of sets that differ by less than this factor share a band.
BAND = 1.1
_rng = np.random.default_rng(20240301)
MULTIPLIERS = _rng.integers(1, 1 << 63, 2 * HALVES * DEPTH, dtype="uint64") * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(1, 1 << 63, 2 * HALVES * DEPTH, dtype="uint64")
LOWER = np.arange(256, dtype="uint8")
LOWER[ord("A") : ord("Z") + 1] += 32
SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("halves", pa.list_(pa.int64())), ("body", pa.int64())])


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct runs of WORDS words, or of the whole sequence if it is shorter; none without words."""
    words = word_hashes(LOWER[as_bytes(text)])
    return np.unique(run_hashes(words, min(WORDS, len(words)))) if len(words) else words


def set_key(own: np.ndarray) -> int:
    """A hash of the set, which names all documents with that set."""
    return int(mix(np.array([mix(own, 1).sum(dtype="uint64") ^ (mix(own, 2).sum(dtype="uint64") << np.uint64(1))]), len(own)).view("int64")[0])


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * HALVES keys for each nonempty set; equal keys of the same place mean equal minhashes there."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    least = np.stack([np.minimum.reduceat((flat ^ m) * a, starts) for a, m in zip(MULTIPLIERS, MASKS, strict=True)], 1)
    out = np.empty((len(sets), 2 * HALVES), "uint64")
    for i in range(2 * HALVES):
        key = np.full(len(sets), i, "uint64")
        for j in range(DEPTH):
            key = mix(key) + least[:, i * DEPTH + j]
        out[:, i] = mix(key, i)
    return out.view("int64")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t) for t in part["text"].to_pylist()]
            full = [s for s in sets if len(s)]
            keys = iter(half_keys(full).tolist() if full else [])
            columns = [part["doc_id"], [len(s) for s in sets], [set_key(s) if len(s) else None for s in sets], [next(keys) if len(s) else None for s in sets], part["body"]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, SKETCH.types, strict=True)], schema=SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("own", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t) for t in part["text"].to_pylist()]
            rows = [(n, s.view("int64")) for n, s in zip(part["node"].to_pylist(), sets, strict=True) if len(s) and set_key(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=schema)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs(a, b) whose full sets are similar enough."""
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _close_in_size(x: Column, y: Column) -> Column:
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _band(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(BAND))).cast("int")


def _torn(met: DataFrame, links: DataFrame, keep: Written) -> DataFrame:
    """(node, n_shingles, bucket, component) of the buckets that hold several components."""
    groups = components(links, keep)
    placed = met.select("node", "n_shingles", "bucket").join(groups, "node", "left").select("node", "n_shingles", "bucket", F.coalesce("component", "node").alias("component"))
    torn = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return keep(placed.join(torn, "bucket", "left_semi"), "torn")


def _stars(met: DataFrame, links: DataFrame, sets: DataFrame, keep: Written) -> tuple[DataFrame, DataFrame]:
    """More stars in torn buckets: STARS other nodes, by as many hashes, are held against all nodes of other components. In a
    group of edited copies, where any two are similar with some chance, these join nearly all, at a cost linear in its size."""
    torn = _torn(met, links, keep)
    if torn.isEmpty():
        return links, torn
    hubs = torn.groupBy("bucket").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "node"), "node", "component", "n_shingles")).alias(f"h{i}") for i in range(STARS)])
    hubs = hubs.select("bucket", F.explode(F.array(*[f"h{i}" for i in range(STARS)])).alias("h")).select("bucket", F.col("h.node").alias("hub"), F.col("h.component").alias("other"), F.col("h.n_shingles").alias("size")).distinct()
    pairs = torn.join(hubs, "bucket").where((F.col("component") != F.col("other")) & _close_in_size(F.col("size"), F.col("n_shingles")))
    pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = keep(links.unionByName(_confirmed(pairs, sets)), "links")
    return links, _torn(met, links, keep)


def prefix_pairs(rest: DataFrame, sets: DataFrame, keep: Written) -> DataFrame:
    """All pairs (a, b) of rest(node, component) of different components that can be similar enough, found without probability.

    Of each set's hashes, ordered from the rarest, two similar sets of n and m hashes share one at places i and j such that what
    lies from there on suffices in both: PERCENT * (n + m) <= (100 + PERCENT) * (n - i + 1), and the like for m and j. A hash's place
    so bounds the size of the other set, and most hashes allow none. Those that do meet in cells of a hash and a band of
    sizes: each entry stands in the cell of its own band if it serves a partner of its size or more, and in the cells of all bands of
    the smaller partners that it serves. Two sets that share a hash and also the shared hash before it have met there already,
    so a passage of many hashes pairs its sets once and not at each of them."""
    elements = rest.join(sets, "node").select("node", "component", F.size("own").alias("n"), F.explode("own").alias("x"))
    elements = keep(elements, "elements")
    often = elements.groupBy("x").agg(F.count("*").alias("often"))
    order = W.partitionBy("node").orderBy("often", "x")
    ranked = elements.join(often, "x").select("x", "node", "component", "n", "often", F.row_number().over(order).alias("i"), F.lag("x").over(order).alias("before"))
    most = F.floor((100 + PERCENT) * (F.col("n") - F.col("i") + 1) / PERCENT) - F.col("n")
    prefix = ranked.where("often > 1").withColumn("most", most.cast("int")).where(100 * F.col("most") >= PERCENT * F.col("n"))
    prefix = keep(prefix.drop("often", "i"), "prefix")
    useful = prefix.groupBy("x").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("before").alias("b1"), F.max("before").alias("b2"), F.count_if(F.col("before").isNull()).alias("first"))
    prefix = prefix.join(useful.where("c1 < c2 AND (first > 0 OR b1 < b2)").select("x"), "x", "left_semi")
    small = prefix.where("most >= n").select("x", _band(F.col("n")).alias("band"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("before").alias("pa"))
    bands = F.sequence(_band(F.ceil(PERCENT * F.col("n") / 100)), _band(F.least("n", "most")))
    large = prefix.select("x", F.explode(bands).alias("band"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("before").alias("pb"))
    fits = F.expr(f"ca <> cb AND na <= nb AND nb <= ma AND na <= mb AND 100 * na >= {PERCENT} * nb AND COALESCE(pa <> pb, true)")
    return large.join(small, ["x", "band"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(nodes: DataFrame, docs: DataFrame, keep: Written) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes(node, n_shingles, first_id, body, halves) that are similar enough
    and share a table.

    A half key that one node alone has makes no table worth keeping, so nodes without a shared half key on both sides are
    done. In each table's bucket every node is held against the bucket's smallest node only, which is linear in
    its size; buckets that stay in several components get a few more such stars. One that is still in several may hide
    links between its other nodes; all nodes of such buckets go through `prefix_pairs`."""
    halves = nodes.select("node", F.posexplode("halves").alias("place", "key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    halves = keep(halves.join(shared, "key", "left_semi"), "halves")
    left, right = (halves.where(f"place {sign} {HALVES}").select("node", F.col("key").alias(k)) for sign, k in (("<", "l"), (">=", "r")))
    tables = keep(left.join(right, "node").select("node", F.xxhash64("l", "r").alias("bucket")), "tables")
    keep.drop("halves")
    buckets = tables.groupBy("bucket").agg(F.count("*").alias("k"), F.min("node").alias("first")).where("k > 1").select("bucket", "first")
    met = keep(tables.join(buckets, "bucket").join(nodes.select("node", "n_shingles"), "node"), "met")
    keep.drop("tables")
    wanted = met.select("node").distinct().join(nodes.select("node", "first_id", "body"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    texts = wanted.join(texts, wanted["first_id"].eqNullSafe(texts["id"]) & (wanted["body"] == texts["body"])).select("node", "text")
    sets = texts.mapInArrow(_sets, T.StructType([T.StructField("node", T.LongType()), T.StructField("own", T.ArrayType(T.LongType()))]))
    sets = keep(sets.dropDuplicates(["node"]), "sets")
    sizes = nodes.select(F.col("node").alias("first"), F.col("n_shingles").alias("size"))
    pairs = met.where("node <> first").select("first", "node", "n_shingles").distinct().join(sizes, "first")
    pairs = pairs.where(_close_in_size(F.col("size"), F.col("n_shingles"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = keep(_confirmed(pairs, sets), "links")

    links, torn = _stars(met, links, sets, keep)
    rest = keep(torn.select("node", "component").distinct(), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(keep(prefix_pairs(rest, sets, keep), "more"), sets))
    return links


def near_duplicates(docs: DataFrame, keep: Written | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text).

    Documents with equal sets are one node, named by a 64-bit hash of the set, and its copies are never held against each other;
    links lie between nodes. Null and blank texts have an empty set, are linked with nothing and kept. Repeated rows of an id
    share a component and are all kept if one is. A row with a null id joins its component, is kept only if no row of it has an
    id. An empty table gives an empty result; other columns are ignored. The result reads the tables "sketch" and "names" of keep."""
    keep = keep or Written(docs.sparkSession)
    since = keep.n
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(own.withColumn("body", F.xxhash64("text")).mapInArrow(_sketch, from_arrow_schema(SKETCH)), "sketch")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).alias("least")
    nodes = keep(rows.where("node IS NOT NULL").groupBy("node").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves")).select("node", "least.body", F.col("least.doc_id").alias("first_id"), "n_shingles", "halves"), "nodes")
    groups = components(near_links(nodes, own, keep), keep)
    named = nodes.select("node", "first_id").join(groups, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    named = keep(named, "named")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = keep(named.join(names, "component").select("node", "component_id"), "names")
    keep.only("sketch", "names", since=since)
    out = rows.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
