"""All detectors: contract, known change points, optimality against brute force, parameters."""

from itertools import combinations

import numpy as np
import pytest

from tidemark.functions import costs as C
from tidemark.functions import numeric as N
from tidemark.functions import windowing as W
from tidemark.operators import base, params, scores, search, states  # noqa: F401

rng = np.random.default_rng(42)
STEPS = np.concatenate([rng.normal(m, s, k) for m, s, k in ((-0.8, 0.2, 300), (0.5, 0.25, 400), (-0.1, 0.1, 300))])
PAIR = np.stack([STEPS, np.concatenate([rng.normal(m, s, k) for m, s, k in ((0.4, 0.18, 300), (-0.3, 0.25, 400), (0.6, 0.22, 300))])], 1)
FAST = {
    "TiccDetector": {"n_states": 3, "beta": 20.0, "maxIters": 3, "window_size": 3},
    "HdpHsmmDetector": {"n_iter": 3},
    "HidalgoDetector": {"n_iter": 10},
    "EspressoDetector": {"n_segments": 3},
    "WindowDetector": {"n_cps": 2},
    "TGLADDetector": {"window_size": 100, "stride": 50},
    "TireDetector": {"n_segments": 3, "max_epochs": 2},
    "BeastDetector": {"mcmc_samples": 100},
    "ICIDDetector": {"t": 20},
    "KCPDDetector": {"n_cps": 2, "jump": 10},
}


@pytest.mark.parametrize("name", list(base.names()))
def test_contract(name):
    detector = base.create(name, **FAST.get(name, {}))
    for x in (STEPS[150:450], PAIR[200:420]):
        if x.ndim == 2 and not detector.multivariate:
            with pytest.raises(ValueError):
                detector.fit_predict(x)
            continue
        out = detector.fit_predict(x)
        assert out.dtype.kind == "i"
        if detector.dense:
            assert len(out) == len(x)
        else:
            assert sorted(set(out.tolist())) == out.tolist() and all(0 < c < len(x) for c in out)
    for bad in ([[np.nan]], [[["a"]]], np.zeros((2, 2, 2))):
        with pytest.raises((ValueError, TypeError)):
            detector.fit_predict(bad)
    assert len(detector.fit_predict(np.empty((0, 1)))) == 0
    short = detector.fit_predict([1.0, 2.0, 3.0]) if name not in ("KCPDDetector",) else []
    assert len(short) == 3 if detector.dense else len(short) <= 3
    assert detector.clone().get_params() == detector.get_params()
    assert detector.tags()["returns_dense"] != detector.dense


@pytest.mark.parametrize("detector", [search.BinSegDetector(n_cps=2), search.BottomUpDetector(n_cps=2), search.DynpDetector(n_cps=2), search.PeltDetector(), search.WindowDetector(n_cps=2), search.KCPDDetector(n_cps=2, jump=10), search.InformationGainDetector(k_max=2), scores.BOCDDetector(), scores.BeastDetector(mcmc_samples=500)])
def test_recovers_steps(detector):
    out = detector.fit_predict(STEPS)
    assert len(out) == 2 and abs(out - [300, 700]).max() <= 5


def test_states_recover_steps():
    for detector, gap in ((states.AutoPlaitDetector(), 15), (states.PatssDetector(), 25), (states.VSAXDetector(), 50)):
        cps = N.change_points_of(detector.fit_predict(PAIR))
        assert all(any(abs(c - t) <= gap for c in cps) for t in (300, 700))
    assert len(set(states.VSAXDetector().fit_predict(np.full(200, 3.0)).tolist())) == 1


def test_information_gain_steps():
    r = np.random.RandomState(0)
    x = np.concatenate([r.normal(m, 1, 100) for m in (0, 5, -3)])
    out = search.InformationGainDetector(k_max=2, step=5).fit_predict(x)
    assert all(min(abs(out - t)) <= 5 for t in (100, 200))


@pytest.mark.parametrize("model", ["l2", "l1", "normal", "rbf", "cosine"])
def test_dynamic_program_is_optimal(model):
    x = np.random.default_rng(1).normal(size=(24, 2)).cumsum(0)
    cost, least = C.cost_of(model, x)
    one = lambda s, e: float(cost(np.array([s]), np.array([e]))[0])
    total = lambda cps: sum(one(s, e) for s, e in zip([0, *cps], [*cps, 24], strict=True))
    size = max(2, least)
    best = min(total(c) for c in combinations(range(1, 24), 2) if all(e - s >= size for s, e in zip([0, *c], [*c, 24], strict=True)))
    assert total(C.dynamic_program(cost, 24, size, 1, 2)) == pytest.approx(best)
    every = min(total(c) + 3.0 * (k + 1) for k in range(4) for c in combinations(range(1, 24), k) if all(e - s >= size for s, e in zip([0, *c], [*c, 24], strict=True)))
    found = C.pelt(cost, 24, size, 1, 3.0)
    if len(found) <= 3:
        assert total(found) + 3.0 * (len(found) + 1) == pytest.approx(every)


def test_costs_by_definition():
    x = np.random.default_rng(2).normal(size=(20, 3))
    s, e = 4, 15
    own = x[s:e]
    at = lambda m: float(C.cost_of(m, x)[0](np.array([s]), np.array([e]))[0])
    assert at("l2") == pytest.approx(len(own) * own.var(0).sum())
    assert at("l1") == pytest.approx(np.abs(own - np.median(own, 0)).sum())
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    assert at("cosine") == pytest.approx(len(own) - (unit @ unit.T).sum() / len(own))
    assert at("linear") == pytest.approx(np.linalg.lstsq(own[:, 1:], own[:, 0], rcond=None)[1][0])


def test_viterbi_and_switching_path():
    r = np.random.default_rng(4)
    emit, move, start = np.log(r.random((7, 3))), np.log(r.dirichlet(np.ones(3), 3)), np.log(r.dirichlet(np.ones(3)))
    from itertools import product

    value = lambda p: start[p[0]] + emit[np.arange(7), p].sum() + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))
    paths = [np.array(p) for p in product(range(3), repeat=7)]
    assert value(N.viterbi(start, move, emit)) == pytest.approx(max(map(value, paths)))
    price = lambda p: -emit[np.arange(7), p].sum() + 0.7 * (p[1:] != p[:-1]).sum()
    assert price(N.switching_path(-emit, 0.7)) == pytest.approx(min(map(price, paths)))


def test_assignment():
    from itertools import permutations

    r = np.random.default_rng(5)
    for n, m in ((3, 3), (2, 4), (4, 2)):
        cost = r.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert sum(cost[i, j] for i, j in N.assignment(cost)) == pytest.approx(best)


def test_distances_and_profile():
    x = np.random.default_rng(6).normal(size=80).cumsum()
    far, w = W.distances(x, 8), 8
    z = lambda v: (v - v.mean()) / (v.std() if v.std() >= 1e-3 else 1)
    assert far[3, 40] == pytest.approx(((z(x[3:11]) - z(x[40:48])) ** 2).sum())
    offsets = W.neighbours(far, w, 3)
    profile = W.split_profile(offsets, w, 16)
    for s in (20, 33, 50):
        vote = W.votes(offsets, s, w)
        right, ones = vote[s:].sum(), vote.sum()
        assert profile[s] == pytest.approx(0.5 * (1 + right / ones - (len(vote) - s - right) / (len(vote) - ones)))


def test_parameters():
    with pytest.raises(ValueError):
        search.BinSegDetector(model="other")
    with pytest.raises(ValueError):
        search.WindowDetector()
    with pytest.raises(ValueError):
        search.WindowDetector(n_cps=1, pen=2.0)
    with pytest.raises(ValueError):
        search.AmocDetector(min_size=0)
    assert {h["name"] for h in params.hints(search.AmocDetector)} == {"min_size"}

    def own(x):
        return lambda s, e: float(((x[s:e] - x[s:e].mean(0)) ** 2).sum())

    assert search.BinSegDetector(model=own, n_cps=2, jump=50).fit_predict(STEPS).tolist() == [300, 700]


def test_transform(spark):
    rows = [(k, t, [float(v)]) for k, part in (("a", STEPS), ("b", STEPS[:500])) for t, v in enumerate(part)]
    df = spark.createDataFrame(rows, "series_id string, t long, x array<double>").repartition(5)
    out = {(r.series_id, r.cp) for r in search.PeltDetector().transform(df).collect()}
    assert out == {("a", 300), ("a", 700), ("b", 300)}
    own = spark.createDataFrame([("a", 1), ("b", None)], "series_id string, n_cps int")
    out = [r.series_id for r in search.DynpDetector(n_cps=2, jump=10).transform(df, own).collect()]
    assert out.count("a") == 1 and out.count("b") == 2
    dense = states.HMMDetector().transform(df)
    assert dense.count() == len(rows) and dense.columns == ["series_id", "t", "state"]
    bad = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [None])], "series_id string, t long, x array<double>")
    with pytest.raises(Exception, match="missing values"):
        search.PeltDetector().transform(bad).collect()


def test_fit_predict_and_reset():
    x = np.concatenate([np.zeros(60), np.ones(60)])[:, None] + np.random.default_rng(0).normal(0, 0.05, (120, 1))
    detector = search.BinSegDetector(n_cps=1)
    assert not detector.is_fitted
    with pytest.raises(ValueError):
        detector.predict(x)
    assert detector.fit(x, np.repeat([0, 1], 60)).is_fitted and detector.get_fitted_params() == {"n_points": 120, "n_channels": 1}
    assert detector.predict(x).tolist() == detector.fit_predict(x).tolist() == [60]
    with pytest.raises(ValueError):
        detector.predict(np.hstack([x, x]))
    with pytest.raises(ValueError):
        detector.fit(x, [1, 2])
    assert not detector.reset().is_fitted and detector.clone().get_params() == detector.get_params()


def test_random_states_differ_between_series():
    one = states.RandomDetector(random_state=1)
    x = np.zeros((200, 1))
    a, b = (one.for_series(k).fit_predict(x).tolist() for k in "ab")
    assert a != b and a == one.for_series("a").fit_predict(x).tolist()
