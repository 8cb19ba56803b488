"""Repeated passages of whole texts by suffix arrays, their common prefixes and longest previous factors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Written, unused
from .hashing import BASE, BYTE_CODES, as_bytes, mix, prefix_sums, span_hashes

LENGTH, GRAM = 200, 32
#: Positions of one piece of a text fit in this many bits below a 43-bit hash.
POSITION_BITS = 21
#: Suffixes that one sort holds, about, and different contents in a block; a key with more is dealt to several blocks.
SORT_STARTS, BLOCK_ROWS = 1 << 16, 3000
#: Suffixes laid out at once in a sort.
STEP = 1 << 14
U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (GRAM a power of two), by doubling."""
    out, width, factor = BYTE_CODES[data], 1, BASE
    while width < GRAM:
        out = out[:-width] * U(factor) + out[width:]
        width, factor = 2 * width, factor * factor & (2**64 - 1)
    return mix(out)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchored(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts the starts of all LENGTH-byte windows of a text into runs that share their least GRAM-byte string (the leftmost
    of equals): pos and count of starts, the string's hash, and a hash of the run's bytes. Which string a window
    has depends on its bytes alone, so equal windows, wherever they start, lie in runs of the same hash."""
    found = []
    step = (1 << POSITION_BITS) - LENGTH
    sums = prefix_sums(data) if len(data) >= LENGTH else None
    for at in range(0, max(0, len(data) - LENGTH + 1), step):
        own = gram_hashes(data[at : at + step + LENGTH - 1])
        keys = (own >> U(POSITION_BITS)) << U(POSITION_BITS) | np.arange(len(own), dtype="uint64")
        least = sliding_least(keys, LENGTH - GRAM + 1) & U((1 << POSITION_BITS) - 1)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        count = np.diff(np.append(first, len(least)))
        found.append((at + first, count, own[least[first].astype("int64")], span_hashes(sums, at + first, at + first + count + LENGTH - 1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, "int64") for _ in range(4))


RUNS = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for doc, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                pos, n, anchor, content = anchored(as_bytes(text))
                rows.append((np.full(len(pos), doc), pa.array([doc_id] * len(pos), pa.int64()), pos, n.astype("int32"), anchor.view("int64"), content.view("int64")))
            columns = list(zip(*rows, strict=True))
            ids = pa.concat_arrays(columns[1])
            yield pa.RecordBatch.from_arrays([ids if i == 1 else pa.array(np.concatenate(c), t) for i, (c, t) in enumerate(zip(columns, RUNS.types, strict=True))], schema=RUNS)


def suffix_array(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of data at starts by their first LENGTH bytes, equal ones as given, and how many bytes each has in
    common with the one before it in that order (LENGTH at most; 0 for the first)."""
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    firsts = first_bytes(data, starts)
    order, prefixes = np.argsort(firsts, kind="stable"), np.zeros(len(starts), "int64")
    firsts = firsts[order]
    ends = np.flatnonzero(np.append(firsts[1:] != firsts[:-1], True)) + 1 if len(starts) else np.empty(0, "int64")
    at = 0
    while at < len(order):  # whole groups of equal first bytes at a time, so that few suffixes are laid out at once
        upto = int(ends[max(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + STEP, "right") - 1)])
        own = windows[starts[order[at:upto]]]
        inner = np.argsort(own.view(f"S{LENGTH}").ravel(), kind="stable")
        order[at:upto], own = order[at:upto][inner], own[inner]
        before = windows[starts[order[at - 1]]][None] if at else ~own[:1]
        differ = own != np.concatenate([before, own[:-1]])
        prefixes[at:upto] = np.where(differ.any(1), differ.argmax(1), LENGTH)
        at = upto
    return order, prefixes


def first_bytes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first eight bytes of the suffixes at starts, as numbers in their order."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[starts].view(">u8").ravel().astype("uint64")


def _to_smaller(place: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """For each entry in suffix order, how many bytes it has in common with the nearest entry before it of a smaller place (0 if there
    is none). Entries that are not smaller are skipped together with all that these have skipped, so few rounds are needed."""
    before, common = np.arange(len(place)) - 1, prefixes.copy()
    open_ = np.flatnonzero(before >= 0)
    open_ = open_[place[before[open_]] > place[open_]]
    while len(open_):
        over = before[open_]
        upto, least = before[over], np.minimum(common[open_], common[over])
        before[open_], common[open_] = upto, least
        open_ = open_[upto >= 0]
        open_ = open_[place[before[open_]] > place[open_]]
    return np.where(before >= 0, common, 0)


def previous_factors(place: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array in suffix order: how many bytes a suffix has in common with one of a smaller place, at most.
    The best such suffix is the nearest one with a smaller place before or after it in suffix order."""
    after = _to_smaller(place[::-1], np.append(0, prefixes[:0:-1]))[::-1] if len(place) else prefixes
    return np.maximum(_to_smaller(place, prefixes), after)


def factor_flags(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at ascending starts: whether their first LENGTH bytes start elsewhere among these, and whether at a smaller start."""
    order, prefixes = suffix_array(data, starts)
    elsewhere, previous = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    elsewhere[order] = np.maximum(prefixes, np.append(prefixes[1:], 0)) >= LENGTH
    previous[order] = previous_factors(order, prefixes) >= LENGTH
    return elsewhere, previous


MEMBER = pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])
FOUND = pa.schema([("doc", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("key", pa.int64()), ("members", pa.list_(MEMBER)), ("bytes", pa.binary())])
#: Strings that one row takes to the second sort.
PACKET = 1000
#: Bytes that Spark hands to a Python worker at once; it holds them outside its heap, and so does the worker.
BATCH_BYTES = 8 << 20


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The strings of a column, joined."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], "int64")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", "uint8")[ends[0] : ends[-1]]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The column of strings that _bytes_of() joins, by where each ends, with a 0 before."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("int32")), pa.py_buffer(np.ascontiguousarray(data))])


def _found(rows: pa.Table, first_stays: bool, go_on: bool) -> Iterator[pa.RecordBatch]:
    """Ranges of starts that repeat, for runs of whole keys, whose suffixes are sorted together; a run that comes twice, from a repeated
    row, counts once. go_on: and of blocks of an anchor, the strings that are the first of their kind there, in packets of those that
    have a key in common; equal strings of an anchor have equal keys, and an anchor has as many keys as parts. All is held in
    columns: an object for each string would take several times the string."""
    doc, pos, ids = rows["doc"].to_numpy(), rows["pos"].to_numpy(), rows["doc_id"].combine_chunks()
    order = np.lexsort((pos, doc, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)))
    again = np.append(False, (np.diff(doc[order]) == 0) & (np.diff(pos[order]) == 0))
    rows = rows.take(pa.array(order[~again])).combine_chunks()
    n, data, ids = rows["n"].to_numpy().astype("int64"), _bytes_of(rows["bytes"].combine_chunks()), rows["doc_id"].combine_chunks()
    own = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n) + inner
    elsewhere, previous = factor_flags(data, starts)
    doc, low = rows["doc"].to_numpy()[own], rows["pos"].to_numpy()[own] + inner
    hit = np.flatnonzero(previous if first_stays else elsewhere)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)
    first, last = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(low[first]), pa.array(low[last] + 1), *(pa.nulls(len(first), t) for t in FOUND.types[3:])], schema=FOUND)
    parts = rows["parts"].to_numpy().astype("uint64")[own] if go_on else None
    left = np.flatnonzero(~previous & (parts > 0)) if go_on else []
    if len(left):
        which = span_hashes(prefix_sums(data), starts[left], starts[left] + LENGTH) % parts[left]
        keys = mix(rows["anchor"].to_numpy().view("uint64")[own[left]] + which).view("int64")
        left, keys = left[order := np.argsort(keys, kind="stable")], keys[order]
        edges = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ 1)).tolist() + [len(keys)]
        cuts = np.array([i for at, end in zip(edges, edges[1:], strict=False) for i in range(at, end, PACKET)] + [len(keys)])
        windows, at = np.lib.stride_tricks.sliding_window_view(data, LENGTH), 0
        while at < len(cuts) - 1:  # a few packets at a time, at least one
            upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + STEP, "right")) - 1)
            some, ends = left[cuts[at] : cuts[upto]], cuts[at : upto + 1] - cuts[at]
            members = pa.StructArray.from_arrays([pa.array(doc[some]), ids.take(pa.array(own[some])), pa.array(low[some])], fields=list(MEMBER))
            columns = [pa.array(keys[cuts[at:upto]]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members), _strings(windows[starts[some]], ends * LENGTH)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(upto - at, t) for t in FOUND.types[:3]), *columns], schema=FOUND)
            at = upto


def _unpack(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The strings of packets as runs of one start, copied out of the batch; other rows as they are."""
    if "members" not in rows.schema.names:
        return rows
    members, each = rows["members"].flatten(), rows["members"].value_lengths().to_numpy()
    doc, doc_id, pos = (pa.concat_arrays([x, x[:0]]) for x in members.flatten())
    data = _bytes_of(rows["bytes"]).copy()
    columns = {"key": pa.array(np.repeat(rows["key"].to_numpy(), each)), "n": pa.array(np.ones(len(members), "int32")), "bytes": _strings(data, np.arange(len(members) + 1) * LENGTH)}
    return pa.RecordBatch.from_pydict({"doc": doc, "doc_id": doc_id, "pos": pos} | columns)


def _sorter(keys: tuple[str, ...], first_stays: bool, go_on: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = _unpack(batch.slice(at, 64))
                own, n = [part[k].to_numpy() for k in keys], part["n"].to_numpy()
                edges = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in own], axis=0)) + 1).tolist(), part.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    key = tuple(int(k[a]) for k in own)
                    if size > SORT_STARTS and key != last:
                        yield from _found(pa.Table.from_batches(held), first_stays, go_on)
                        held, size = [], 0
                    held.append(part.slice(a, b - a))
                    size, last = size + int(n[a:b].sum()), key
        if held:
            yield from _found(pa.Table.from_batches(held), first_stays, go_on)

    return run


CUTS = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("block", pa.int64()), ("parts", pa.int64()), ("bytes", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(at, 256).to_pylist():
                data = unpacked(r["packed"])
                rows += [(r["doc"], r["doc_id"], w["pos"], w["n"], w["anchor"], w["block"], w["parts"], data[w["pos"] : w["pos"] + w["n"] + LENGTH - 1]) for w in r["wanted"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CUTS.types, strict=True)], schema=CUTS)


def packed_texts(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc (a key of the row's id and text), the text as compressed UTF-8, and extra columns: what is shuffled is the smaller for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = pa.array([squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in part["text"].to_pylist()], pa.binary())
                yield part.set_column(part.schema.get_field_index("text"), "packed", z)

    rows = docs.select(doc_key().alias("doc"), "text", *extra)
    return rows.mapInArrow(run, T.StructType([T.StructField("packed", T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields]))


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def doc_key():
    return F.xxhash64(F.lit(0), F.col("doc_id"), F.coalesce("text", F.lit("")))


def repeat_ranges(docs: DataFrame, keep: Written, first_stays: bool) -> DataFrame:
    """Ranges [low, high) of byte positions of a doc at which LENGTH-byte strings start that also start elsewhere; where first_stays, that
    also start earlier, by doc_id and position.

    Runs of an anchor that no other run has are done after one count. Runs of an anchor that have the same bytes, by two hashes of 128
    bits together, repeat each other, and one of each content goes on if the anchor has several. The suffixes of an anchor's contents
    are sorted, a few anchors at a time, and those that have LENGTH bytes in common with another, or with an earlier one by the
    longest-previous-factor array, are found. An anchor with more than BLOCK_ROWS contents is dealt to blocks by content, each sorted as
    well; the first strings of each kind in a block then go by a hash of their bytes to a second sort, in parts of about SORT_STARTS
    strings at most, where a string comes once a block at most."""
    keep.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    own = docs.select(doc_key().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = keep(own.mapInArrow(_runs, from_arrow_schema(RUNS)), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("k"), (F.min("content") != F.max("content")).alias("mixed")).where("k > 1").select("anchor", "mixed")
    runs = keep(runs.join(keep(anchors, "anchors"), "anchor"), "repeated")
    keep.drop("runs")
    order = F.struct("doc_id", "doc", "pos", "n")
    contents = runs.groupBy("anchor", "content", "mixed").agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    contents = keep(contents.select("anchor", "content", "mixed", "copies", "first.*"), "contents")
    several = contents.where("copies > 1").select("anchor", "content", F.col("doc").alias("d1"), F.col("pos").alias("p1"))
    copies = runs.join(several, ["anchor", "content"])
    if first_stays:
        copies = copies.where("NOT (doc = d1 AND pos = p1)")
    copies = keep(copies.select("doc", F.col("pos").alias("low"), (F.col("pos") + F.col("n")).alias("high")), "copies")
    keep.drop("repeated")
    sorted_ = contents.where("mixed")
    widths = keep(sorted_.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"), F.ceil(F.sum("n") / SORT_STARTS).alias("parts")), "widths")
    wanted = sorted_.join(widths, "anchor").withColumn("block", F.pmod(F.xxhash64("content"), "blocks")).withColumn("parts", F.expr("IF(blocks > 1, parts, 0)"))
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("pos", "n", "anchor", "block", "parts")).alias("wanted"))
    cuts = packed_texts(own, ("doc_id",)).join(wanted, "doc").select("doc", "doc_id", "packed", "wanted").mapInArrow(_cut, from_arrow_schema(CUTS))
    blocks = cuts.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    found = keep(blocks.mapInArrow(_sorter(("anchor", "block"), first_stays, True), from_arrow_schema(FOUND)), "found")
    again = found.where("key IS NOT NULL").select("key", "members", "bytes").repartition("key").sortWithinPartitions("key")
    again = again.mapInArrow(_sorter(("key",), first_stays, False), from_arrow_schema(FOUND))
    out = copies
    for x in (found.where("key IS NULL"), keep(again, "again")):
        out = out.unionByName(x.select("doc", "low", "high"))
    return out


def covered(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings starting in the ranges cover."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"] + LENGTH - 1) for r in ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(at, 256).to_pylist():
                data, spans = unpacked(r["packed"]), covered(r["ranges"] or [])
                rows.append((r["doc_id"], len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), REMOVED.types, strict=True)], schema=REMOVED)


def _by_doc(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): n_bytes, n_removed and n_spans of the bytes covered by a 200-byte string that also starts
    elsewhere, and the hash of what remains. A null text is empty; texts under 200 bytes lose nothing. Rows with the same
    id and text repeat each other like any other two rows. Null ids are fine. An empty table gives an empty result; other
    columns are ignored."""
    keep = Written(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = keep(_by_doc(repeat_ranges(own, keep, first_stays=False)), "ranges")
    keep.only("ranges")
    return packed_texts(own, ("doc_id",)).join(ranges, "doc", "left").select("doc_id", "packed", "ranges").mapInArrow(_digests, from_arrow_schema(REMOVED))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with later copies of passages of 200 bytes or more taken out of the texts; the first copy, by doc_id and position, stays. A
    character that a cut splits goes with the cut. n_chars, if there, follows the text; texts that lose nothing stay as they are, nulls
    too. A row that repeats an earlier row, id and text, stays as it is, being the same document."""
    keep = Written(docs.sparkSession)
    ranges = keep(_by_doc(repeat_ranges(docs, keep, first_stays=True)), "ranges")
    keep.only("ranges")
    key, spans = (unused(name, docs.columns) for name in ("doc", "ranges"))
    rows = docs.withColumn(key, doc_key()).join(ranges.toDF(key, spans), key, "left").select(*docs.columns, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                for i, r in enumerate(part[spans].to_pylist()):
                    if r:
                        texts[i] = without(texts[i].encode("utf-8", "surrogatepass"), covered(r)).decode("utf-8", "ignore")
                names = part.schema.names
                columns = [pa.array(texts, part.schema.field(n).type) if n == "text" else part[n] for n in names[:-1]]
                yield pa.RecordBatch.from_arrays(columns, names=names[:-1])

    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
