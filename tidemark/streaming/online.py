"""Online scoring of series in Structured Streaming, and windows of event time."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..llm.common import shared_dir
from ..operators.scores import Sdar


@dataclass
class OnlineChangeFinder:
    """Two SDAR stages with trailing means between and after; a value at a time."""

    order: int = 5
    discount: float = 0.005
    smooth: int = 7
    warm: list[float] = field(default_factory=list)
    stages: list = field(default_factory=list)
    recent: tuple = ((), ())

    def update(self, value: float) -> float:
        if not self.stages:
            self.warm.append(value)
            if len(self.warm) < max(2 * self.order, 30):
                return 0.0
            self.stages = [Sdar(self.order, self.discount), Sdar(self.order, self.discount)]
            self.stages[0].warm_up(np.array(self.warm))
            return 0.0
        out = value
        for i, stage in enumerate(self.stages):
            score = stage.update(float(out))
            self.recent = tuple((*r, score)[-self.smooth :] if i == j else r for j, r in enumerate(self.recent))
            out = sum(self.recent[i]) / len(self.recent[i])
        return out

    def many(self, values: np.ndarray) -> np.ndarray:
        """update() of each value in turn, a stage at a time."""
        at = 0
        while at < len(values) and not self.stages:
            self.update(float(values[at]))
            at += 1
        out = values[at:]
        for i, stage in enumerate(self.stages):
            line = [*self.recent[i], *stage.many(out).tolist()]
            start = len(self.recent[i]) + 1
            spans = (line[max(0, end - self.smooth) : end] for end in range(start, len(line) + 1))
            out = np.fromiter((sum(s) / len(s) for s in spans), float, len(out))
            self.recent = tuple(tuple(line[-self.smooth :]) if i == j else r for j, r in enumerate(self.recent))
        return np.append(np.zeros(at), out)


@dataclass
class OnlineBocd:
    """Posterior of the run length under a Normal-Gamma model and a constant hazard; the longest runs beyond `most` merge into the last."""

    hazard: float = 300.0
    mu: float = 0.0
    kappa: float = 1.0
    alpha: float = 1.0
    beta: float = 1.0
    most: int = 400

    def __post_init__(self):
        self.p = np.array([1.0])
        self.m, self.k, self.a, self.b = (np.array([v], float) for v in (self.mu, self.kappa, self.alpha, self.beta))

    def update(self, value: float) -> float:
        """Probability that the run began with this value."""
        scale = self.b * (self.k + 1) / (self.a * self.k)
        half = np.vectorize(math.lgamma)
        log = half(self.a + 0.5) - half(self.a) - 0.5 * np.log(2 * math.pi * self.a * scale) - (self.a + 0.5) * np.log1p((value - self.m) ** 2 / (2 * self.a * scale))
        joint = self.p * np.exp(log)
        p = np.append(joint.sum() / self.hazard, joint * (1 - 1 / self.hazard))
        p = p / p.sum() if p.sum() > 0 else np.append(1.0, np.zeros(len(joint)))
        m, k = (self.k * self.m + value) / (self.k + 1), self.k
        self.b = np.append(self.beta, self.b + k * (value - self.m) ** 2 / (2 * (k + 1)))
        self.m, self.k, self.a = np.append(self.mu, m), np.append(self.kappa, k + 1), np.append(self.alpha, self.a + 0.5)
        if len(p) > self.most:
            p[self.most - 1] += p[self.most :].sum()
            p, self.m, self.k, self.a, self.b = (v[: self.most] for v in (p, self.m, self.k, self.a, self.b))
        self.p = p
        return float(p[0])

    def many(self, values: np.ndarray) -> np.ndarray:
        """update() of each value in turn. What depends on the length of a run alone is made once."""
        most, out = self.most, np.empty(len(values))
        k, a = (np.array(list(accumulate([step] * (most - 1), initial=start))) for start, step in ((self.kappa, 1.0), (self.alpha, 0.5)))
        half = np.vectorize(math.lgamma)
        gain, k1, ak, pa, a2, ah, kk = half(a + 0.5) - half(a), k + 1, a * k, 2 * math.pi * a, 2 * a, a + 0.5, 2 * (k + 1)
        p, m, b = (np.empty(most + 1) for _ in range(3))
        x, y, z = (np.empty(most) for _ in range(3))
        n, rest = len(self.p), 1 - 1 / self.hazard
        p[:n], m[:n], b[:n] = self.p, self.m, self.b
        held = None
        for i, value in enumerate(values.tolist()):
            if held != n:
                held, (gain_, k_, k1_, ak_, pa_, a2_, ah_, kk_, x_, y_, z_) = n, (v[:n] for v in (gain, k, k1, ak, pa, a2, ah, kk, x, y, z))
                p_, m_, b_, p1, m1, b1 = p[:n], m[:n], b[:n], p[1 : n + 1], m[1 : n + 1], b[1 : n + 1]
            np.multiply(b_, k1_, out=x_)
            np.divide(x_, ak_, out=x_)  # the scale
            np.subtract(value, m_, out=y_)
            np.multiply(y_, y_, out=y_)
            np.multiply(a2_, x_, out=z_)
            np.divide(y_, z_, out=z_)
            np.log1p(z_, out=z_)
            np.multiply(ah_, z_, out=z_)
            np.multiply(pa_, x_, out=x_)
            np.log(x_, out=x_)
            np.multiply(x_, 0.5, out=x_)
            np.subtract(gain_, x_, out=x_)
            np.subtract(x_, z_, out=x_)
            np.exp(x_, out=x_)
            np.multiply(p_, x_, out=x_)  # with the value
            first = x_.sum() / self.hazard
            np.multiply(x_, rest, out=p1)
            p[0] = first
            total = p[: n + 1].sum()
            if total > 0:
                np.divide(p[: n + 1], total, out=p[: n + 1])
            else:
                p[: n + 1] = 0.0
                p[0] = 1.0
            np.multiply(k_, y_, out=y_)
            np.divide(y_, kk_, out=y_)
            np.add(b_, y_, out=b1)
            b[0] = self.beta
            np.multiply(k_, m_, out=y_)
            np.add(y_, value, out=y_)
            np.divide(y_, k1_, out=m1)
            m[0] = self.mu
            n += 1
            if n > most:
                p[most - 1] += p[most]
                n = most
            out[i] = p[0]
        self.p, self.m, self.k, self.a, self.b = p[:n].copy(), m[:n].copy(), k[:n], a[:n], b[:n].copy()
        return out


@dataclass
class AdaptiveThreshold:
    """Whether a window is like the last one; the bar rises where likeness is common, and falls where it is rare."""

    bar: float = 0.9
    rate: float = 0.05

    def update(self, likeness: float) -> float:
        same = likeness >= self.bar
        self.bar = min(0.999, max(0.0, self.bar + self.rate * (likeness - self.bar) * (1 if same else 0.5)))
        return float(same)

    def many(self, values: np.ndarray) -> np.ndarray:
        return np.array([self.update(v) for v in values.tolist()], float)


#: Rows that a worker scores and hands back at once.
PIECE = 65536
MODELS: dict[str, Callable] = {"changefinder": OnlineChangeFinder, "bocd": OnlineBocd, "threshold": AdaptiveThreshold}


def scored(stream: DataFrame, key: str, time: str, value: str, model: str, delay: str = "1 hour", **params) -> DataFrame:
    """(series_id, t, value, score) of a stream, one model a key. Rows wait until the watermark has passed them and are then taken in
    the order of time, so that the scores don't depend on how rows were batched; later rows are dropped."""
    make = MODELS[model]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, t, v, last = pickle.loads(state.get[0]) if state.exists else (make(**params), np.empty(0, np.int64), np.empty(0), -1)
        found = [(f["t"].to_numpy(np.int64), f["value"].to_numpy(float)) for f in frames]
        t, v = np.concatenate([t, *(x for x, _ in found)]), np.concatenate([v, *(y for _, y in found)])
        t, v = t[t > last], v[t > last]
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        n = int(np.searchsorted(t, state.getCurrentWatermarkMs() * 1000, side="right"))
        scores = [held.many(v[i : min(n, i + PIECE)]) for i in range(0, n, PIECE)]
        last = int(t[n - 1]) if n else last
        state.update((pickle.dumps((held, t[n:], v[n:], last)),))
        if n < len(t):
            state.setTimeoutTimestamp(max(int(t[n]) // 1000, state.getCurrentWatermarkMs()) + 1)
        for i, score in zip(range(0, n, PIECE), scores, strict=True):
            j = i + len(score)
            yield pd.DataFrame({"series_id": [group[0]] * (j - i), "t": t[i:j], "value": v[i:j], "score": score})

    rows = stream.select(F.col(key).cast("string").alias("series_id"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", delay).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id string, t long, value double, score double", "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(stream: DataFrame, key: str, time: str, value: Column, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """`value` for each key and window; a row counts if it isn't later than the delay."""
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    out = rows.groupBy(F.col(key).cast("string").alias("series_id"), F.window("_at", width, slide or width).alias("w")).agg(value.alias("value"))
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str = "1 hour") -> DataFrame:
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    out = rows.groupBy(F.col(key).cast("string").alias("series_id"), F.session_window("_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is now, as a Parquet table in the folder that driver and executors share."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    into = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    last: list[str] = []

    def put(batch: DataFrame, i: int) -> None:
        """A batch that has the whole result so far."""
        batch.write.mode("overwrite").parquet(f"{folder}/{i}")
        last[:] = [f"{folder}/{i}"]

    query = into.format("parquet").option("path", f"{folder}/all").start() if mode == "append" else into.foreachBatch(put).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if mode == "append" and query.lastProgress is not None:
        last = [f"{folder}/all"]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The files of a table as a stream; the pattern lets a table that is a single file be one."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{table[0]}]{table[1:]}.parquet")
