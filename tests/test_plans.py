"""Statements in two engines, adapters, and streams against the batch."""

import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import costs as C
from tidemark.operators.scores import Sdar
from tidemark.plans import queries as Q
from tidemark.plans import statements as S
from tidemark.sources import frames
from tidemark.streaming import online

SF = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(tuple(round(float(v), 5) if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.BASE:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["amoc", "cost_l2_grid", "cost_cosine_grid", "window_ncps", "collapse_labels", "aggregate_cps", "metric_covering", "metric_ami", "metric_wari", "metric_f1", "acf_width", "binseg_k3", "stream_hourly"])
def test_two_engines(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({Q.ORACLE_SQL[name]})").fetchall()
    assert canonical(tuple(r) for r in got.select(*columns).collect()) == canonical(want)


def test_amoc_of_values_whose_squares_outgrow_a_bigint(spark, tmp_path):
    """The sum of squares first (then the other engine has an answer too), then a single square."""
    for t in ("events", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    days = spark.range(40).selectExpr("'p' AS o_orderpriority", "timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS o_orderdate", "id")
    days.selectExpr("o_orderpriority", "o_orderdate", "2e7 + IF(id < 23, 0, 5e6) + id % 3 AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(Q.ORACLE_SQL["amoc_orders_daily"]).fetchall()
    assert [tuple(r) for r in Q.QUERIES["amoc_orders_daily"](spark, str(tmp_path)).collect()] == want and want[0][1] == 23
    days.selectExpr("o_orderpriority", "o_orderdate", "2e8 + IF(id < 23, 0, 5e7) + id % 3 AS o_totalprice").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert Q.QUERIES["amoc_orders_daily"](spark, str(tmp_path)).first().cp == 23


def test_binseg_statement_is_the_search(spark):
    series = Q.plan(spark, SF, S.EVENTS_HOURLY, {})
    found = Q.QUERIES["binseg_k3"](spark, SF).collect()
    for k in {r.series_id for r in series.select("series_id").distinct().collect()}:
        v = np.array([r.v for r in series.where(series.series_id == k).orderBy("t").collect()], float)
        cost, _ = C.cost_of("l2", v[:, None])
        assert sorted(r.cp for r in found if r.series_id == k) == C.binary_segmentation(cost, len(v), 2, 5, n_cps=3)


def test_adapters(spark, tmp_path):
    (tmp_path / "walk.csv").write_text("1,2,3,4,0\n5,6,7,8,1\r\n9,10,11,12,1\n")
    rows = frames.read_mocap(spark, str(tmp_path / "walk.csv")).orderBy("t").collect()
    assert [(r.series_id, r.t, list(r.x), r.y) for r in rows] == [("walk", 0, [1, 2, 3, 4], 0), ("walk", 1, [5, 6, 7, 8], 1), ("walk", 2, [9, 10, 11, 12], 1)]
    df = spark.createDataFrame([("a", 2, 5.0, 1.0), ("a", 1, 3.0, 1.0), ("b", 9, 1.0, 1.0)], "k string, ts long, v double, w double")
    series = frames.from_table(df, "k", "ts", ["v", "w"])
    assert sorted((r.series_id, r.t, tuple(r.x)) for r in series.collect()) == [("a", 0, (3.0, 1.0)), ("a", 1, (5.0, 1.0)), ("b", 0, (1.0, 1.0))]
    assert sorted((r.series_id, r.t, tuple(r.x)) for r in frames.scaled(series).collect()) == [("a", 0, (-1.0, 0.0)), ("a", 1, (1.0, 0.0)), ("b", 0, (0.0, 0.0))]
    frames.write_series(series, str(tmp_path / "out"))
    assert frames.read_series(spark, str(tmp_path / "out")).count() == 3
    labels = spark.createDataFrame([("a", t, s) for t, s in enumerate([1, 1, 2, 2, 1])], "series_id string, t long, state int")
    assert sorted((r.seg_id, r.start, r.end, r.state) for r in frames.segments_of(labels).collect()) == [(0, 0, 2, 1), (1, 2, 4, 2), (2, 4, 5, 1)]


@pytest.mark.parametrize("model", ["changefinder", "bocd"])
def test_stream_is_batch(spark, tmp_path, model):
    """Rows in two files, the second with earlier rows within the delay, score as in one pass in order of time."""
    base = 1_700_000_000
    rows = [("k", base + 60 * i, float(np.sin(i) + (i > 60) * 4)) for i in range(120)]
    order = [*range(0, 50), *range(55, 70), *range(50, 55), *range(70, 120)]
    frame = lambda ids: spark.createDataFrame([rows[i] for i in ids], "key string, s long, value double").selectExpr("key", "timestamp_seconds(s) AS ts", "value").coalesce(1)
    frame(order[:65]).write.parquet(str(tmp_path / "in"))
    frame(order[65:]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.t, r.score) for r in online.drained(online.scored(stream, "key", "ts", "value", model)).collect())
    one = online.MODELS[model]()
    want = [(s * 1_000_000, one.update(v)) for _, s, v in rows]
    assert got == [(t, pytest.approx(v)) for t, v in want[: len(got)]] and len(got) >= 10


@pytest.mark.parametrize("model, params", [("bocd", {"mu": 5.0, "beta": 2.0, "most": 40}), ("bocd", {"most": 1})])
def test_many_updates_are_single_ones_bocd(model, params):
    check_many(model, params)


@pytest.mark.parametrize("params", [{}, {"order": 1, "smooth": 1}, {"order": 3, "smooth": 9}])
def test_many_updates_are_single_ones_changefinder(params, monkeypatch):
    """And a block at once: no value but the first few goes through update()."""
    check_many("changefinder", params)
    model, values, calls = online.OnlineChangeFinder(**params), np.random.default_rng(4).normal(size=500), []
    update = Sdar.update
    monkeypatch.setattr(Sdar, "update", lambda self, value: calls.append(value) or update(self, value))
    assert len(model.many(values)) == 500 and len(calls) <= model.order


def check_many(model, params):
    """Values scored some at a time, with the state written in between, as one by one."""
    rng = np.random.default_rng(3)
    values = np.round(np.concatenate([rng.gamma(2, 5, 150), rng.gamma(2, 9, 150), np.full(60, 4.0)]), 2)
    one, many = online.MODELS[model](**params), online.MODELS[model](**params)
    want, got = [one.update(v) for v in values.tolist()], []
    for part in np.split(values, [1, 1, 4, 29, 31, 38, 200]):
        got += many.many(part).tolist()
        many = pickle.loads(pickle.dumps(many))
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12) and many.update(7.0) == pytest.approx(one.update(7.0))


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drained_stays_out_of_the_driver(spark, tmp_path, mode):
    """What streams give is files in the shared folder; a table in the driver's memory has none."""
    spark.range(4000).selectExpr("CAST(id % 1000 AS STRING) AS key", "timestamp_seconds(id * 60) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    windows = {"append": lambda s: online.sessions(s, "key", "ts", "2 hours"), "complete": lambda s: online.tumbling(s, "key", "ts", F.count("*"), "1 day")}
    got = online.drained(windows[mode](stream), mode)
    assert got.inputFiles() and all(f.startswith("file:" + spark.conf.get("spark.checkpoint.dir").split("//")[1]) or f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in got.inputFiles())
    want = windows[mode](spark.read.parquet(str(tmp_path / "in"))).where(F.lit(mode == "complete") | (F.col("end") <= F.timestamp_seconds(F.lit(3999 * 60 - 3600))))
    assert got.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
    (tmp_path / "none").mkdir()
    assert online.drained(windows[mode](spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "none"))), mode).count() == 0


def test_adaptive_threshold():
    bar = online.AdaptiveThreshold(0.5, 0.1)
    assert bar.update(0.9) == 1 and bar.bar > 0.5 and bar.update(0.1) == 0


def test_converters(spark):
    from tidemark.operators import convert as V

    rows = lambda df: sorted(tuple(r) for r in df.collect())
    labels = spark.createDataFrame([("a", t, s) for t, s in enumerate([7, 7, 3, 3, 7])] + [("b", 0, 1)], "series_id string, t long, state int")
    lengths = spark.createDataFrame([("a", 5), ("b", 1), ("c", 0)], "series_id string, n long")
    cps = V.change_points(labels)
    assert rows(cps) == [("a", 2), ("a", 4)]
    assert rows(V.with_ends(cps, lengths.where("n > 0"))) == [("a", 0), ("a", 2), ("a", 4), ("a", 5), ("b", 0), ("b", 1)]
    assert rows(V.without_ends(V.with_ends(cps, lengths), lengths)) == [("a", 2), ("a", 4)]
    assert [r[2] for r in rows(V.state_labels(cps, lengths))] == [0, 0, 1, 1, 2, 0]
    assert [r[2] for r in rows(V.classification(cps, lengths))] == [0, 0, 1, 0, 1, 0]
    assert rows(V.labels_of_segments(frames.segments_of(labels))) == rows(labels)
    assert [r[2] for r in rows(V.expanded(labels, 2))] == [7, 7, 7, 7, 3, 3, 3, 3, 7, 7, 1, 1]
    assert [r[2] for r in rows(V.by_first_seen(labels))] == [0, 0, 1, 1, 0, 0]
    series = labels.selectExpr("series_id", "t", "array(CAST(state AS DOUBLE)) AS x")
    assert rows(V.sliding_windows(series, 3, 2).select("series_id", "t")) == [("a", 0), ("a", 2)]
    tall = spark.createDataFrame([("a", 0, t, v) for t, v in enumerate([None, 1.0, float("nan"), 3.0, None])], "series_id string, channel int, t long, value double")
    assert [r[3] for r in rows(V.interpolated(tall))] == [0.0, 0.0, 0.5, 1.0, 1.0]
    windows = spark.createDataFrame([("a", 0, 2), ("a", 1, 1)], "series_id string, start long, label int")
    assert [r[2] for r in rows(V.vote(windows, lengths, 3))] == [2, 1, 1, 1, 0, 0]
