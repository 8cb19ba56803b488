"""Packing of tokenized documents into fixed-length sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Written, parts

LENGTH = 2048
END_ID = 1


class TournamentTree:
    """Bins in order of opening; finds the first with room. A node holds the largest free room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, need: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        at = i - self.leaves
        room[i] -= need
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at


def first_fit_decreasing(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of lengths (1..length), the longest first and equal ones in the order given."""
    bins, offsets, used = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64"), {}
    tree = TournamentTree(max(1, len(lengths)), length)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = tree.place(need)
        bins[i], offsets[i] = at, used.get(at, 0)
        used[at] = offsets[i] + need
    return bins, offsets


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None):
    """text -> ids of a `tokenizers` file without special tokens added. Where `ranks` names the same vocabulary as
    byte ranks, the same ids come from the faster library; texts with the string of a special token, which the
    file's own tokenizer treats apart, still go through that."""
    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer)

    plain = lambda text: exact().encode(text, add_special_tokens=False).ids
    if ranks is None:
        return plain
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    with open(tokenizer, encoding="utf-8") as f:
        apart = [t["content"] for t in json.load(f)["added_tokens"]]
    return lambda text: plain(text) if any(x in text for x in apart) else fast.encode_ordinary(text)


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def squeezed(ids: np.ndarray) -> bytes:
    """Ids as compressed bytes, low halves before high ones; about a third of four bytes each."""
    return zstandard.compress(ids.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes(), 3)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u2").reshape(2, -1).T.copy().view("<u4").ravel().astype("int32")


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut every `length` ids, with _copy, which names the row of docs, and with_ids the ids as
    `squeezed` bytes. A null text counts as empty and gives the end id alone."""
    schema = PIECES.append(pa.field("_copy", pa.int64()))
    schema = schema.append(pa.field("_ids", pa.binary())) if with_ids else schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that a few very long texts are the most that is held
                rows = []
                for doc_id, text, copy in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    ids = np.append(np.asarray(encode(text or ""), "<u4"), np.uint32(end_id))
                    for start in range(0, len(ids), length):
                        own = ids[start : start + length].astype("<u4")
                        rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), copy) + ((squeezed(own),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id())
    return own.mapInArrow(cut, from_arrow_schema(schema))


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids.

    Documents fall into random groups of about `group` (a hash); each group is packed alone, so a task holds the last pieces of
    one group's documents at a time. Pieces of the full length, which come first in any first-fit decreasing and fill a sequence
    each, take no part in it and are not shuffled, so that a document of any length adds one piece to its group. Sequence ids are unique but
    not gapless. Null texts are empty; null ids and repeated rows stay rows of their own; an empty table gives an
    empty result. Other columns of docs are ignored."""
    keep = Written(docs.sparkSession)
    cut = keep(pieces(docs, tokenizer, ranks, length, end_id, with_ids), "pieces")
    full, rest = cut.where(F.col("length") == length), cut.where(F.col("length") < length)
    groups = parts(rest.count(), group)
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_copy"), F.lit(groups)).cast("int"))

    def spelt(rows: pa.Table) -> pa.Table:
        if not with_ids:
            return rows.drop_columns("_copy")
        ids = pa.chunked_array([pa.array([unsqueezed(x) for x in c.to_pylist()], pa.list_(pa.int32())) for c in rows["_ids"].chunks], pa.list_(pa.int32()))
        return rows.drop_columns(["_copy", "_ids"]).append_column("ids", ids)

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_copy", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        first = table["_group"][0].as_py() << 32
        return spelt(table.drop_columns("_group").append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from spelt(pa.Table.from_batches([batch.slice(at, 256)])).to_batches()

    fields = [*from_arrow_schema(PIECES).fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    result = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else fields)
    alone = full.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    alone = alone.mapInArrow(spell, result) if with_ids else alone.drop("_copy")
    return dealt.groupBy("_group").applyInArrow(pack_group, result).unionByName(alone)
