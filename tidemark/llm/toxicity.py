"""Toxicity from subword bags: word vectors are means of character n-gram vectors, a text is the mean of its most
telling words, and a linear softmax reads it. Vectors and softmax are trained together, in numpy."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written

BUCKETS, DIM, GRAMS = 1 << 18, 4, (3, 5)
WARM, ROUNDS, BATCH, RATE = 2, 30, 256, 0.1
#: A text's vector is the mean of this many of its words, the worst, so that a few words count in long texts too.
TOP = 3
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"
#: A run of more characters than LONG without white space, as of languages that write none, is read as pieces of PIECE characters,
#: each half over the next, and as what stands between inner punctuation.
LONG, PIECE = 64, 16
INNER = re.compile("[" + re.escape(STRIP + "/\\+=~^@`") + "\u2010-\u2027\u2039\u203a\u00ab\u00bb\u00b7\u3000-\u3003\u3008-\u3011\u30fb\uff01-\uff0f\uff1a-\uff20]+")
_cache: dict[bytes, dict[str, float]] = {}


def distinct_words(text: str | None) -> list[str]:
    """The different words of a text, lower-cased, without punctuation at their ends; [""] if there are none. Of a run over LONG
    characters all pieces count as words, so that none of its n-grams is left out."""
    words: set[str] = set()
    for w in {w.strip(STRIP) for w in set((text or "").lower().split())}:
        if len(w) <= LONG:
            words.add(w)
        else:
            words.update(w[at : at + PIECE] for at in range(0, len(w) - PIECE // 2, PIECE // 2))
            words.update(x for x in INNER.split(w) if len(x) <= LONG)
    return sorted(words - {""}) or [""]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word itself and of its character n-grams, with marks at both ends, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    lengths = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters of the word from here on
    own, who = [np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked], "uint64")], [np.arange(len(marked))]
    mixed = np.zeros(len(codes), "uint64")
    for n in range(1, GRAMS[1] + 1):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.append(codes[n - 1 :], np.zeros(min(n - 1, len(codes)), "uint64"))[: len(codes)] + np.uint64(1)
        if n >= GRAMS[0]:
            inside = left >= n
            own.append((mixed[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40))
            who.append(owner[inside])
    who, own = np.concatenate(who), np.concatenate(own)
    return (own[np.argsort(who, kind="stable")] % np.uint64(BUCKETS)).astype("int32"), np.bincount(who, minlength=len(words))


def _step(state: dict, bags: list[np.ndarray], truth: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
    """One Adagrad step of vectors, softmax and bias on bags of words."""
    vectors, softmax, bias = state["vectors"], state["softmax"], state["bias"]
    lengths = np.array([len(b) for b in bags])
    words, back = np.unique(np.concatenate(bags), return_inverse=True)
    counts = ends[words + 1] - ends[words]
    starts = np.cumsum(counts) - counts
    ids = flat[np.repeat(ends[words] - starts, counts) + np.arange(counts.sum())]
    word_vectors = np.add.reduceat(vectors[ids], starts) / counts[:, None]
    mean = np.add.reduceat(word_vectors[back], np.cumsum(lengths) - lengths) / lengths[:, None]
    logits = mean @ softmax + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    error = (p / p.sum(1, keepdims=True) - truth) / len(bags)
    d_softmax, d_bias = mean.T @ error, error.sum(0)
    spread = np.repeat(error @ softmax.T / lengths[:, None], lengths, axis=0)
    d_words = np.stack([np.bincount(back, spread[:, k], len(words)) for k in range(DIM)], 1) / counts[:, None]
    d_words = np.repeat(d_words, counts, axis=0)
    touched, place = np.unique(ids, return_inverse=True)
    d_vectors = np.stack([np.bincount(place, d_words[:, k], len(touched)) for k in range(DIM)], 1).astype("float32")
    state["vectors_sq"][touched] += (d_vectors**2).mean(1)
    vectors[touched] -= RATE * d_vectors / np.sqrt(state["vectors_sq"][touched])[:, None]
    state["softmax_sq"] += d_softmax**2
    softmax -= (RATE * d_softmax / np.sqrt(state["softmax_sq"])).astype("float32")
    state["bias_sq"] += d_bias**2
    bias -= (RATE * d_bias / np.sqrt(state["bias_sq"])).astype("float32")


def train(texts: list[str | None], labels: np.ndarray, seed: int = 1, warm: int = WARM, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Fits the n-gram vectors and the softmax. `warm` epochs read all words of a text that other texts have too; then each of
    `rounds` rounds reads of each text the TOP words that look worst so far, as scoring does: a clean text's are
    pushed down and a toxic one's up. Of two classes only the difference of the softmax's rows matters, so the
    fitted model is returned as each bucket's share of the log odds, and the bias."""
    vocabulary: dict[str, int] = {}
    bags = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in distinct_words(t)], "int32") for t in texts]
    if not bags or len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, "float32"), (20.0 if len(labels) and labels[0] else -20.0) if len(bags) else 0.0
    words = list(vocabulary)
    flat, counts = map(np.concatenate, zip(*(subwords(words[at : at + 10_000]) for at in range(0, len(words), 10_000)), strict=True))
    ends = np.concatenate([[0], np.cumsum(counts)])
    seen = np.bincount(np.concatenate(bags), minlength=len(vocabulary))
    rng = np.random.default_rng(seed)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    state = {"vectors": rng.normal(0, 0.1, (BUCKETS, DIM)).astype("float32"), "softmax": rng.normal(0, 0.1, (DIM, 2)).astype("float32"), "bias": np.log([1 - rate, rate]).astype("float32")}
    state |= {f"{k}_sq": np.full(v.shape[:1] if k == "vectors" else v.shape, 1e-8, "float32") for k, v in list(state.items())}
    truth = np.eye(2, dtype="float32")[labels.astype(int)]
    for turn in range(warm + rounds):
        if turn < warm:
            own = [x if len(x := b[seen[b] > 1]) else b[:1] for b in bags]
        else:
            odds = state["vectors"] @ (state["softmax"][:, 1] - state["softmax"][:, 0])
            of_word = np.add.reduceat(odds[flat], ends[:-1]) / np.diff(ends)
            own = [b if len(b) <= TOP else b[np.argpartition(of_word[b], -TOP)[-TOP:]] for b in bags]
        for _ in range(1 if turn < warm else 2):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                _step(state, [own[i] for i in some], truth[some], flat, ends)
    softmax, bias = state["softmax"], state["bias"]
    return (state["vectors"] @ (softmax[:, 1] - softmax[:, 0])).astype("float32"), float(bias[1] - bias[0])


def pack_model(odds: np.ndarray, bias: float) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, odds=odds, bias=np.float64(bias))
    return out.getvalue()


def score(texts: list[str | None], model: bytes, cached: int = 150_000) -> np.ndarray:
    """Probability of label 1 of each whole text; a text without words gets the score of the empty word."""
    if model not in _cache:
        _cache.clear()
        with np.load(io.BytesIO(model)) as f:
            _cache[model] = {"\0odds": f["odds"], "\0bias": float(f["bias"])}
    known = _cache[model]
    if len(known) > cached:
        _cache[model] = known = {k: known[k] for k in ("\0odds", "\0bias")}
    odds, out, bags = known["\0odds"], np.empty(len(texts)), [distinct_words(t) for t in texts]
    if new := [w for w in {w for b in bags for w in b} if w not in known]:
        flat, counts = subwords(new)
        known.update(zip(new, (np.add.reduceat(odds[flat], np.cumsum(counts) - counts) / counts).tolist(), strict=True))
    for i, bag in enumerate(bags):
        worst = sorted(map(known.__getitem__, bag))[-TOP:]
        out[i] = sum(worst) / len(worst) + known["\0bias"]
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, seed: int = 1) -> bytes:
    """Fits on a sample of at most `sample` labelled rows, those of the lowest hash; that bound makes the ids small
    enough to broadcast, and the sample's texts small enough for one task. labels(doc_id, toxic) has the rows that may be
    learned from; null labels and ids are left out. Of several labels of an id the largest counts, of several texts the smallest."""
    keep = Written(docs.sparkSession)
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = keep(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "sample")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        return pa.table({"model": [pack_model(*train(table["text"].to_pylist(), table["toxic"].to_numpy(), seed))]})

    got = rows.select("doc_id", "text", "toxic").groupBy().applyInArrow(learn, "model binary").collect()
    keep.only()
    return bytes(got[0].model) if got else pack_model(np.zeros(BUCKETS, "float32"), 0.0)


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with a column score, by whole texts; all other columns and rows stay as they are. A null text counts as empty.
    A column named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS floats
    held = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.append_column("score", pa.array(score(part["text"].to_pylist(), shared.value)))

    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("score", T.DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    """The labelled rows whose crc32(doc_id as text) mod 4 isn't 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. A null id is never held out."""
    model = fit(docs, learnable(labels), sample)
    scored = score_documents(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
