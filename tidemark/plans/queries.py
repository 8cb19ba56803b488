"""Registered queries over the driver's tables: statements with their text for another engine, and detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import scores, search, states
from ..sources import frames
from ..streaming import online
from . import rounds
from . import statements as S
from .run import composed, run

SERIES, WIDE = {"series": S.EVENTS_HOURLY}, {"wide": S.LINEITEM_WIDE}
MARKED = {"labels": S.LABELS, "cps": S.CPS}
#: name: (statement, its inputs)
STATEMENTS: dict[str, tuple[str, dict[str, str]]] = {
    "series_events_hourly": (S.EVENTS_HOURLY, {}),
    "series_orders_daily": (S.ORDERS_DAILY, {}),
    "series_lineitem_wide": (S.LINEITEM_WIDE, {}),
    "amoc": (S.AMOC, SERIES),
    "amoc_orders_daily": (S.AMOC, {"series": S.ORDERS_DAILY}),
    "cost_l2_grid": (S.COST_L2, SERIES),
    "cost_l1_grid": (S.COST_L1, SERIES),
    "cost_normal_grid": (S.COST_NORMAL, SERIES),
    "cost_linear_grid": (S.COST_LINEAR, WIDE),
    "cost_cosine_grid": (S.COST_COSINE, WIDE),
    "window_ncps": (S.WINDOW_NCPS, SERIES),
    "dynp_k2": (S.DYNP_K2, SERIES),
    "ggs_step": (S.GGS_STEP, SERIES),
    "prophet_grid": (S.PROPHET_GRID, SERIES),
    "knn_join": (S.KNN, SERIES),
    "matrix_profile": (S.PROFILE, SERIES),
    "fluss_curve": (S.FLUSS, SERIES),
    "clasp_profile": (S.CLASP_PROFILE, SERIES),
    "acf_width": (S.ACF, SERIES),
    "dft_width": (S.DFT, SERIES),
    "suss_score": (S.SUSS, SERIES),
    "extract_cps": (S.EXTRACT_CPS, MARKED),
    "labels_to_cps": (S.LABELS_TO_CPS, MARKED),
    "cps_to_labels": (S.CPS_TO_LABELS, MARKED),
    "collapse_labels": (S.COLLAPSE, MARKED),
    "reorder_labels": (S.REORDER, MARKED),
    "aggregate_cps": (S.AGGREGATE, MARKED),
    "l2_norm": (S.L2_NORM, WIDE),
    "vote_labels": (S.VOTE, MARKED),
    "metric_covering": (S.COVERING, MARKED),
    "metric_bicovering": (S.BICOVERING, MARKED),
    "metric_hausdorff": (S.HAUSDORFF, MARKED),
    "metric_ari": (S.ARI, MARKED),
    "metric_nmi": (S.NMI, MARKED),
    "metric_ami": (S.AMI, MARKED),
    "metric_wari": (S.WARI, MARKED),
    "metric_wnmi": (S.WNMI, MARKED),
}
BASE = ("events", "orders", "lineitem")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE}


def plan(spark: SparkSession, sf_dir: str, statement: str, inputs: dict[str, str]) -> DataFrame:
    base = tables(spark, sf_dir)
    given = {k: run(spark, v, **base) for k, v in inputs.items() if "{" + k + "}" in statement}
    if statement == S.AMOC:  # it sums squares of v, which outgrow a BIGINT; the other engine sums in 128 bits, as this does then
        given["series"] = given["series"].withColumn("v", F.col("v").cast("decimal(19,0)"))
    return run(spark, statement, **base, **given)


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(spark, sf_dir, *STATEMENTS[name])


def _marked(metric: Callable[[DataFrame], DataFrame], statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        out = metric(run(spark, statement, **tables(spark, sf_dir)))
        return out.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return query


#: Detectors on hourly event values (one channel a type) or monthly quantities (three channels).
HOURLY = {
    "pelt_l2": search.PeltDetector(penalty=4.0),
    "bottomup_k3": search.BottomUpDetector(n_cps=3),
    "dynp_kernel_k2": search.DynpDetector(n_cps=2, jump=10),
    "kcpd_rbf": search.KCPDDetector(n_cps=2, jump=10),
    "window_pen": search.WindowDetector(pen=5.0),
    "bocd": scores.BOCDDetector(),
    "changefinder": scores.ChangeFinderDetector(),
    "fluss": scores.FLUSSDetector(window_size=24, n_segments=3),
    "clasp": scores.ClaspDetector(n_change_points=2),
    "espresso": scores.EspressoDetector(window_size=24, n_segments=3),
    "icid": scores.ICIDDetector(window_size=24, t=50),
    "igts_k2": search.InformationGainDetector(k_max=2),
    "prophet": scores.ProphetDetector(),
    "beast": scores.BeastDetector(mcmc_samples=500),
    "tire": scores.TireDetector(n_segments=3, random_state=0, max_epochs=5),
    "tscp2": scores.TSCP2Detector(n_cps=2, window_size=48),
    "hmm": states.HMMDetector(),
    "random_states": states.RandomDetector(random_state=1),
    "vsax": states.VSAXDetector(),
    "hidalgo": states.HidalgoDetector(n_iter=60),
    "hdp_hsmm": states.HdpHsmmDetector(n_iter=10),
    "autoplait": states.AutoPlaitDetector(),
    "clap": states.ClapDetector(n_change_points=2),
    "patss": states.PatssDetector(),
    "time2state": states.Time2StateDetector(window_size=48, step=12),
    "e2usd": states.E2USDDetector(window_size=48, step=12),
    "vqtss": states.VQTSSDetector(window_size=24),
}
MONTHLY = {
    "ggs": search.GreedyGaussianDetector(k_max=3, random_state=0),
    "eagglo": search.EAggloDetector(),
    "ticc": states.TiccDetector(window_size=3, n_states=2, beta=10.0, maxIters=10),
    "tglad": scores.TGLADDetector(window_size=24, stride=6, threshold=0.3),
}


def _detect(detector, monthly: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        if monthly:
            wide = plan(spark, sf_dir, S.LINEITEM_WIDE, {})
            series = wide.select("series_id", "t", F.array(*[F.col(c).cast("double") for c in ("a", "n", "r")]).alias("x"))
        else:
            values = plan(spark, sf_dir, S.EVENTS_HOURLY, {})
            series = frames.scaled(values.select("series_id", "t", F.array(F.col("v").cast("double")).alias("x")))
        return detector.transform(series)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: _statement(n) for n in STATEMENTS},
    "binseg_k3": lambda spark, sf_dir: rounds.binary_segmentation(plan(spark, sf_dir, S.EVENTS_HOURLY, {}), 3),
    "metric_f1": _marked(lambda df: M.f1_score(df), S.CPS),
    "metric_gaussian_f1": _marked(lambda df: M.gaussian_f1_score(df), S.CPS),
    "metric_sms": _marked(lambda df: M.state_matching_score(df), S.LABELS),
    **{n: _detect(d, False) for n, d in HOURLY.items()},
    **{n: _detect(d, True) for n, d in MONTHLY.items()},
}
ORACLE_SQL: dict[str, str] = {**{n: composed(s, **i) for n, (s, i) in STATEMENTS.items()}, "metric_f1": composed(S.F1_WIDE, **MARKED), "binseg_k3": composed(S.BINSEG_K3, **SERIES)}


def _stream(build: Callable[[DataFrame], DataFrame], mode: str = "append") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: online.drained(build(online.read_stream(spark, sf_dir, "events")), mode)


HOURLY_WINDOWS = """
h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h, COUNT(*) AS value FROM {events} GROUP BY event_type, date_trunc('hour', ts))
SELECT series_id, CAST(h AS VARCHAR(19)) AS start, value FROM h"""
QUERIES |= {
    "stream_changefinder": _stream(lambda s: online.scored(s, "event_type", "ts", "value", "changefinder")),
    "stream_bocd": _stream(lambda s: online.scored(s, "event_type", "ts", "value", "bocd", mu=100.0, beta=1000.0)),
    "stream_hourly": _stream(lambda s: online.tumbling(s, "event_type", "ts", F.count("*"), "1 hour").select("series_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "value"), "complete"),
    "stream_sessions": _stream(lambda s: online.sessions(s, "user_id", "ts", "2 hours"), "append"),
}
ORACLE_SQL["stream_hourly"] = composed(HOURLY_WINDOWS)
