"""SimHash fingerprints, likeness, and search within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Written, parts
from .hashing import as_bytes, mix, run_hashes, word_hashes

BITS = 128
#: Terms are runs of one to this many words.
TERM_WORDS = 2


def fingerprint(text: str | None) -> bytes:
    """BITS signed votes: each term's hash votes +w or -w on every bit, w = 1 + ln(times it occurs), and half of that for
    single words, which unrelated texts of one language share. Texts without a word give zeros."""
    words = word_hashes(as_bytes(text))
    votes = np.zeros(BITS, "float32")
    for n in range(1, TERM_WORDS + 1):
        terms, counts = np.unique(run_hashes(words, n), return_counts=True)
        weights = ((1 + np.log(counts)) * (0.5 if n == 1 else 1.0)).astype("float32")
        for at in range(0, len(terms), 8192):
            own = terms[at : at + 8192]
            bits = np.unpackbits(np.stack([mix(own, k) for k in range(BITS // 64)], 1).view("uint8"), axis=1)
            votes += 2 * (weights[at : at + 8192] @ bits.astype("float32")) - weights[at : at + 8192].sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 at equal fingerprints, 0.5 at unrelated ones, 0 at opposite ones."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT = pa.schema(FIELDS)
EDGES = pa.schema([*FIELDS, ("first_text", pa.string()), ("last_text", pa.string()), ("pid", pa.int32())])


def judged(doc_id: int | None, text: str, following: str, own: bytes, theirs: bytes) -> tuple:
    """A row of RESULT: the text against its edited form, whose second half is replaced by the start of the following text."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    print_ = own if edited == text else fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own.hex(), print_.hex(), likeness(own, print_), likeness(own, theirs)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges every row of a sorted partition against the next; the last waits, with its text, for the next partition's first."""
    held, out, pid, first = None, [], None, None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), EDGES.types, strict=True)], schema=EDGES)

    for x in batches:
        for at in range(0, x.num_rows, 256):
            for doc_id, text, pid in zip(*(c.to_pylist() for c in x.slice(at, 256).columns), strict=True):  # noqa: B007
                own = fingerprint(text)
                if held is None:
                    first = text
                else:
                    out.append((*judged(*held[:2], text, held[2], own), None, None, pid))
                held = (doc_id, text, own)
            if out:
                yield batch()
                out = []
    if held is not None:
        out = [(held[0], len(held[1]), None, held[2].hex(), None, None, None, first, held[1], pid)]
        yield batch()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = [judged(r["doc_id"], r["last_text"], r["following"], bytes.fromhex(r["fingerprint"]), fingerprint(r["following"])) for r in x.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], schema=RESULT)


def against_next(docs: DataFrame, bytes_each: int = 16 << 20, most: int = 50_000, radius: int = 3) -> DataFrame:
    """A row of RESULT for every row of docs(doc_id, text), whose next document is the one of the next doc_id (after the last the
    first; a single document is its own next), and n_near: how many other fingerprints of the table lie within the radius.

    One shuffle sorts the texts by range; a scan of each range holds two texts. The last row of a range, with the first text, is
    kept apart and joined to the next range's, one row a range. Null texts are empty. Null ids come first, rows of equal ids
    stand in the order of a hash of their texts, so that no id fills a range. An empty table gives an empty result; other
    columns are ignored."""
    keep = Written(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = kept.repartitionByRange(min(most, parts(size, bytes_each, 8)), *order).sortWithinPartitions(*order, "text")
    rows = keep(rows.withColumn("pid", F.spark_partition_id()).mapInArrow(_scan, from_arrow_schema(EDGES)), "scan")
    ends = rows.where("edited_sha256 IS NULL")
    by_pid = W.orderBy("pid")  # a row a range, without its texts
    after = ends.select("pid").select("pid", F.coalesce(F.lead("pid").over(by_pid), F.first("pid").over(by_pid.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next"))
    ends = ends.join(after, "pid").join(ends.select(F.col("pid").alias("next"), F.col("first_text").alias("following")), "next")
    closed = ends.select("doc_id", "fingerprint", "last_text", "following").mapInArrow(_close, from_arrow_schema(RESULT))
    rows = rows.where("edited_sha256 IS NOT NULL").select(*RESULT.names).unionByName(closed)
    pairs = keep(near_pairs(keep(rows.select("fingerprint").distinct(), "prints"), radius), "pairs")
    near = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_near"))
    near = keep(near, "near")
    keep.only("scan", "near")
    return rows.join(near, "fingerprint", "left").select(*RESULT.names, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs (a < b, distance) of different fingerprints of prints(fingerprint hex string) within the radius.

    The BITS bits fall into blocks, radius + 2 if not given; two fingerprints within the radius agree on all but at most `radius` of
    them, so each choice of blocks - radius blocks is a table whose key is those blocks, and a pair within the radius meets
    in one of them at least. More blocks make more tables with longer keys, on which fewer others agree. Equal fingerprints are one row
    first, so copies never meet each other. Null and repeated fingerprints, empty tables and other columns are fine; nulls have
    no pairs."""
    blocks = blocks or radius + 2
    own = prints.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    digits = BITS // 4
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    chosen = list(combinations(range(blocks), blocks - radius))
    keys = [F.concat(F.lit(f"{i}:"), *[F.substring("fingerprint", edges[b] + 1, edges[b + 1] - edges[b]) for b in c]) for i, c in enumerate(chosen)]
    table = own.select("fingerprint", F.explode(F.array(*[F.xxhash64(k) for k in keys])).alias("key"))
    a, b = table.withColumnRenamed("fingerprint", "a"), table.withColumnRenamed("fingerprint", "b")
    words = [(i * 15 + 1, min(15, digits - i * 15)) for i in range(-(-digits // 15))]
    off = sum((F.bit_count(F.conv(F.substring("a", s, n), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", s, n), 16, 10).cast("long"))) for s, n in words), F.lit(0))
    return a.join(b, (a["key"] == b["key"]) & F.expr("a < b")).where(off <= radius).select("a", "b", off.alias("distance")).distinct()
