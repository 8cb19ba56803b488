"""Each stage of the pipeline on the smallest tables."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import STAGES, mixing, near_dedup, packing, suffix_dedup
from tidemark.llm import suffixes
from tidemark.llm.common import Written


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    keep, docs = Written(spark), spark.read.parquet(f"{sf}/documents.parquet")
    counts, columns = {}, docs.columns
    for name, stage in STAGES:
        before = docs
        docs = keep(stage(spark, docs, sf), name)
        counts[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "near_dedup"):
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "suffix_dedup":
            seen: set = set()
            for r in docs.orderBy("doc_id").collect():
                own = {r.text[i : i + 210] for i in range(len(r.text) - 209)}
                assert not own & seen
                seen |= own
        if name == "mixing":
            words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
            assert 1.49 <= words(docs.collect()) / words(before.collect()) <= 1.5
    assert counts["toxicity"] >= 0.8 * 200 and counts["near_dedup"] < counts["toxicity"] and counts["packing"] > 0


def test_packing_gives_the_ids(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).withColumn("text", F.expr("IF(doc_id % 7 = 0, repeat(text, 20), text)"))
    mixed = Written(spark)(mixing(spark, docs, sf), "mixed")
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, places = Counter(), Counter(), defaultdict(list)
    for r in mixed.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.update((r.doc_id, len(ids), at, tuple(ids[at : at + 2048])) for at in range(0, len(ids), 2048))
    for r in packing(spark, mixed, sf).collect():
        got[r.doc_id, r.doc_tokens, r.start, tuple(r.ids)] += 1
        places[r.sequence_id].append((r.offset, r.length, len(r.ids)))
    assert got == want and max(got.values()) > 1 and max(k[2] for k in got) > 0
    for own in places.values():
        at = 0
        for offset, length, ids in sorted(own):
            assert offset == at and length == ids
            at += length
        assert at <= 2048


def test_near_dedup_keeps_one_row_of_a_group(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " end"
    rows = [(None, text(1)), (None, text(2)), (None, near(2)), (None, text(3)), (5, near(3)), (6, text(4)), (6, text(4)), (7, text(5)), (7, text(6)), (8, near(6)), (4, near(5)), (None, ""), (9, ""), (9, None), (10, text(7))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    out = near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r.place for r in out.collect()}
    assert out.count() == len(kept) and len(kept & {1, 2}) == len(kept & {5, 6}) == 1
    assert kept - {1, 2, 5, 6} == {0, 4, 8, 10, 11, 12, 13, 14}


def test_suffix_dedup_sorts_in_small_parts(spark, monkeypatch):
    """A passage in all texts: no worker gets many strings of it at once, and the first copy alone stays."""
    rng = random.Random(17)
    text = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    passage, made = text(45), []

    class Kept(Written):
        def only(self, *names, since=0):
            made.append(self)

    monkeypatch.setattr(suffixes, "Written", Kept)
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", 40)
    monkeypatch.setattr(suffixes, "SORT_STARTS", 1000)
    docs = spark.createDataFrame([(i, f"{text(60)} {passage} {text(60)}") for i in range(160)], "doc_id long, text string").repartition(2)
    kept = {r.doc_id: r.text for r in suffix_dedup(spark, docs, "").collect()}
    assert len(kept) == 160 and [i for i, t in kept.items() if passage in t] == [0]
    found = spark.read.parquet(next(path for name, path, _ in made[0].tables if name == "found")).where("key IS NOT NULL")
    sizes = [r.n for r in found.groupBy("key").agg(F.sum(F.size("members")).alias("n")).collect()]
    assert sum(sizes) > 5000 and max(sizes) <= 1500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
