"""Scores with known values, and the plans against plain Python."""

import math

import numpy as np
import pytest

from tidemark.operators import metrics as M


def frame(spark, *series):
    rows = [(f"s{i}", kind, int(c)) for i, (true, pred) in enumerate(series) for kind, cps in (("true", true), ("pred", pred)) for c in cps]
    return spark.createDataFrame(rows, "series_id string, kind string, cp long")


def labels(spark, *series):
    return spark.createDataFrame([(f"s{i}", t, int(a), int(b)) for i, (true, pred) in enumerate(series) for t, (a, b) in enumerate(zip(true, pred, strict=True))], "series_id string, t long, y_true long, y_pred long")


def scores(df):
    return {r.series_id: r.score for r in df.collect()}


TRUE, PRED = np.zeros(50, int), np.zeros(50, int)
TRUE[10:25], TRUE[40:] = 1, 2
PRED[12:28], PRED[38:] = 1, 2


def test_f1(spark):
    assert M.f1([10, 20, 30, 50], [11, 23, 30, 50], 5) == {"score": 1.0, "precision": 1.0, "recall": 1.0}
    assert M.f1([], []) == {"score": 1.0, "precision": 1.0, "recall": 1.0}
    assert M.f1([10, 50], [50])["score"] == 0
    assert M.f1([10, 12, 50], [11, 50], 2)["recall"] == 0.5
    assert scores(M.f1_score(frame(spark, ([10, 20, 30, 50], [11, 23, 30, 50])), margin=5)) == {"s0": 1.0}


def test_gaussian_f1():
    assert M.gaussian_f1([50, 100], [52, 100])["score"] == pytest.approx(math.exp(-2))
    assert M.gaussian_f1([50, 100], [50, 100])["score"] == pytest.approx(1)


def test_covering(spark):
    df = frame(spark, ([0, 10, 20, 30], [0, 15, 30]), ([30], [30]), ([10, 30], [30]))
    assert scores(M.covering(df)) == {"s0": pytest.approx(0.52777778, abs=1e-7), "s1": 1.0, "s2": pytest.approx((10 * (1 / 3) + 20 * (2 / 3)) / 30, abs=1e-7)}
    both = {r.series_id: r for r in M.bidirectional_covering(df).collect()}["s0"]
    assert both.pred_covering == pytest.approx(2 / 3, abs=1e-7) and both.score == pytest.approx(76 / 129, abs=1e-7)
    assert scores(M.bidirectional_covering(df, "min"))["s0"] == pytest.approx(0.52777778, abs=1e-7)


def test_hausdorff(spark):
    assert scores(M.hausdorff(frame(spark, ([10, 20, 30, 50], [11, 23, 30, 45]), ([10], [])))) == {"s0": 5.0, "s1": math.inf}


def test_state_metrics(spark):
    one = np.zeros(20, int)
    df = labels(spark, (TRUE, PRED), (one, one), (TRUE, TRUE), (TRUE, np.zeros(50, int)))
    got = scores(M.adjusted_rand(df))
    assert got["s0"] == pytest.approx(0.5879654908812929, abs=1e-7) and got["s1"] == got["s2"] == 1 and got["s3"] == 0
    got = scores(M.normalized_information(df))
    assert got["s0"] == pytest.approx(0.6034796898085965, abs=1e-7) and got["s1"] == got["s2"] == 1 and got["s3"] == 0
    got = scores(M.adjusted_information(df))
    assert got["s0"] == pytest.approx(0.5863034145872612, abs=1e-6) and got["s1"] == got["s2"] == 1 and got["s3"] == pytest.approx(0, abs=1e-6)


def brute_weighted(true, pred, alpha=0.1):
    edges = [0, *(np.flatnonzero(np.diff(true)) + 1), len(true)]
    d = np.array([min(abs(i - e) for e in edges) for i in range(len(true))]) if len(edges) > 2 else np.full(len(true), len(true))
    w = 1 + alpha * d
    table = np.zeros((true.max() + 1, pred.max() + 1))
    np.add.at(table, (true, pred), w)
    a, b, n, sq = table.sum(1), table.sum(0), table.sum(), (table**2).sum()
    tp, fp, fn = sq - n, (table @ b).sum() - sq, (table.T @ a).sum() - sq
    tn = n**2 - fp - fn - sq
    tp, fp, fn, tn = map(int, (tp, fp, fn, tn))
    rand = 1.0 if fp == fn == 0 else 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    some = table > 0
    mi = (table[some] / n * np.log(table[some] * n / np.outer(a, b)[some])).sum()
    h = lambda p: -(p[p > 0] / n * np.log(p[p > 0] / n)).sum()
    return rand, mi / ((h(a) + h(b)) / 2) if h(a) + h(b) else 1.0


def test_weighted(spark):
    rng = np.random.default_rng(3)
    cases = [(TRUE, PRED), (rng.integers(0, 3, 60), rng.integers(0, 4, 60)), (np.zeros(30, int), np.arange(30) % 2)]
    df = labels(spark, *cases)
    rand, info = scores(M.weighted_rand(df)), scores(M.weighted_information(df))
    for i, c in enumerate(cases):
        want = brute_weighted(*c)
        assert rand[f"s{i}"] == pytest.approx(want[0], abs=1e-7) and info[f"s{i}"] == pytest.approx(want[1], abs=1e-7)


def test_state_matching(spark):
    score, errors = M.state_matching(TRUE, PRED)
    assert score == pytest.approx(0.846, abs=1e-9) and {e["type"] for e in errors} == {"delay"}
    assert M.state_matching([], [])[0] == 1.0
    assert M.state_matching(TRUE, TRUE + 7)[0] == 1.0
    noisy = TRUE.copy()
    noisy[2:4] = 9
    assert M.state_matching(TRUE, noisy)[1][0]["type"] == "isolation"
    noisy = TRUE.copy()
    noisy[22:28] = 9
    assert M.state_matching(TRUE, noisy)[1][0]["type"] == "transition"
    assert scores(M.state_matching_score(labels(spark, (TRUE, PRED))))["s0"] == pytest.approx(0.846)


def test_state_matching_looks_for_the_next_boundary_after_a_block():
    true, pred = [0] * 10 + [1] * 10, [0] * 8 + [2] * 3 + [1] * 9
    score, errors = M.state_matching(np.array(true), np.array(pred))
    assert errors[0]["penalty"] == pytest.approx(M.ERROR_WEIGHTS["transition"] * 3 * 0.8)
    assert score == pytest.approx(1 - (3 + errors[0]["penalty"]) / 20)
    assert M.state_matching(np.array(true), np.array(pred), {"delay": 0.1})[1][0]["penalty"] == pytest.approx(3 * 0.8)
