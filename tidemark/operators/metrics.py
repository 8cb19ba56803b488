"""Scores of change points and states against the truth, one row a series.

Change-point metrics take cps(series_id, kind 'true' or 'pred', cp); state metrics labels(series_id, t, y_true, y_pred)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import assignment
from ..plans import statements as S
from ..plans.run import run


def _plan(statement: str, name: str):
    def metric(df: DataFrame) -> DataFrame:
        return run(df.sparkSession, statement, **{name: df})

    return metric


covering, hausdorff = _plan(S.COVERING, "cps"), _plan(S.HAUSDORFF, "cps")
adjusted_rand, normalized_information, adjusted_information = _plan(S.ARI, "labels"), _plan(S.NMI, "labels"), _plan(S.AMI, "labels")


def bidirectional_covering(cps: DataFrame, aggregation: str = "harmonic") -> DataFrame:
    g, p = F.col("gt_covering"), F.col("pred_covering")
    how = {"harmonic": F.when(g + p > 0, 2 * g * p / (g + p)).otherwise(0.0), "geometric": F.sqrt(g * p), "arithmetic": (g + p) / 2, "min": F.least(g, p)}
    if aggregation not in how:
        raise ValueError(f"aggregation must be one of {sorted(how)}")
    return run(cps.sparkSession, S.BICOVERING, cps=cps).withColumn("score", F.round(how[aggregation], 8))


def weighted_rand(labels: DataFrame, alpha: float = 0.1) -> DataFrame:
    return run(labels.sparkSession, S.WARI.replace("1 + 0.1 *", f"1 + {alpha!r} *"), labels=labels)


def weighted_information(labels: DataFrame, alpha: float = 0.1, average: str = "arithmetic") -> DataFrame:
    how = {"arithmetic": "((ha.h + hp.h) / 2)", "geometric": "SQRT(ha.h * hp.h)", "min": "LEAST(ha.h, hp.h)", "max": "GREATEST(ha.h, hp.h)"}
    text = S.WNMI.replace("1 + 0.1 *", f"1 + {alpha!r} *").replace("ha.h + hp.h = 0 THEN", f"{how[average]} = 0 THEN").replace("mi / ((ha.h + hp.h) / 2)", f"mi / {how[average]}")
    return run(labels.sparkSession, text, labels=labels)


def f1(true: list[int], pred: list[int], margin: float = 0.01) -> dict[str, float]:
    """Each true point, in order, takes the nearest free prediction within the margin (of two as near, the smaller); ends don't count."""
    true, pred = sorted(true), sorted(pred)
    end = true[-1] if true else 0
    reach = int(margin * end) if isinstance(margin, float) else margin
    own, said = [c for c in true if c not in (0, end)], [c for c in pred if c not in (0, end)]
    if not own and not said:
        return {"score": 1.0, "precision": 1.0, "recall": 1.0}
    free, hits = set(said), 0
    for c in own:
        near = min(((abs(p - c), p) for p in free if abs(p - c) <= reach), default=None)
        if near:
            free.discard(near[1])
            hits += 1
    precision, recall = hits / len(said) if said else 0.0, hits / len(own) if own else 0.0
    return {"score": 2 * precision * recall / (precision + recall) if hits else 0.0, "precision": precision, "recall": recall}


def gaussian_f1(true: list[int], pred: list[int], sigma_fraction: float = 0.01, min_sigma: float = 1.0, adaptive_sigma: bool = False) -> dict[str, float]:
    """Pairs weigh exp(-(d / sigma)**2 / 2) and are matched from the heaviest."""
    true, pred = sorted(true), sorted(pred)
    end = max(true) if true else 0
    own, said = [c for c in true if c not in (0, end)], [c for c in pred if c not in (0, end)]
    if not own and not said:
        return {"score": 1.0, "precision": 1.0, "recall": 1.0, "matched_weight": 0.0}

    def sigma(i: int) -> float:
        if not adaptive_sigma:
            return max(min_sigma, sigma_fraction * end)
        gaps = [abs(own[i] - own[j]) for j in (i - 1, i + 1) if 0 <= j < len(own)]
        return max(min_sigma, 0.5 * sum(gaps) / len(gaps)) if gaps else max(min_sigma, 0.1 * end)

    pairs = sorted(((-float(np.exp(-0.5 * ((p - c) / sigma(i)) ** 2)), i, j) for i, c in enumerate(own) for j, p in enumerate(said)))
    used_i, used_j, weight = set(), set(), 0.0
    for w, i, j in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            weight -= w
    precision, recall = weight / len(said) if said else 0.0, weight / len(own) if own else 0.0
    return {"score": 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0, "precision": precision, "recall": recall, "matched_weight": weight}


#: What an error of each kind costs.
ERROR_WEIGHTS = {"delay": 0.1, "transition": 0.3, "isolation": 0.8, "missing": 0.5}


def mapped(true: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Predicted labels renamed to the true ones they overlap most (one to one); one left over keeps its name if that is free, else
    takes the next free number."""
    names, back = np.unique(pred, return_inverse=True)
    truths, own = np.unique(true, return_inverse=True)
    overlap = np.zeros((len(names), len(truths)))
    np.add.at(overlap, (back, own), 1)
    target = {int(names[i]): int(truths[j]) for i, j in assignment(-overlap)}
    used, fresh = set(target.values()), 0
    for name in names.tolist():
        if name not in target:
            if name in used:
                while fresh in used:
                    fresh += 1
                target[name] = fresh
            else:
                target[name] = name
            used.add(target[name])
    return np.array([target[int(v)] for v in names])[back]


def state_matching(true: np.ndarray, pred: np.ndarray, weights: dict[str, float] | None = None) -> tuple[float, list[dict]]:
    """Score and errors: runs of one wrong label, each costing its length and a penalty by its kind; kinds without a weight weigh 1."""
    true, n, weights = np.asarray(true), len(true), ERROR_WEIGHTS if weights is None else weights
    if not n:
        return 1.0, []
    said = mapped(true, np.asarray(pred))
    edges = np.concatenate([[0], np.flatnonzero(true[1:] != true[:-1]) + 1, [n]])
    wrong, errors, i = said != true, [], 0
    while i < n:
        if not wrong[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and wrong[j + 1] and said[j + 1] == said[i]:
            j += 1
        size, runs = j - i + 1, 1 + int((true[i + 1 : j + 1] != true[i:j]).sum())
        beside = [k for k in (i - 1, j + 1) if 0 <= k < n and said[k] == true[k] == said[i]]
        kind = "missing" if runs > 2 else "transition" if runs == 2 else "delay" if beside else "isolation"
        w = weights.get(kind, 1.0)
        if kind == "delay":
            penalty = w * size
        elif kind == "missing":
            penalty = size * w * (1 + 3 * (w - 1) / runs)
        else:
            before, after = i - edges[edges <= i].max(), edges[edges > j].min() - j
            penalty = size * w * 2 * min(before, after) / n
        errors.append({"type": kind, "start": i, "end": j, "size": size, "penalty": float(penalty)})
        i = j + 1
    return 1 - sum(e["size"] + e["penalty"] for e in errors) / n, errors


def _by_series(df: DataFrame, one, names: list[str]) -> DataFrame:
    def run_(table: pa.Table) -> pa.Table:
        return pa.table({"series_id": pa.array([table["series_id"][0].as_py()], pa.string()), **{k: pa.array([float(v)]) for k, v in one(table).items()}})

    return df.groupBy("series_id").applyInArrow(run_, "series_id string, " + ", ".join(f"{n} double" for n in names))


def _kinds(table: pa.Table) -> tuple[list[int], list[int]]:
    rows = list(zip(table["kind"].to_pylist(), table["cp"].to_pylist(), strict=True))
    return [c for k, c in rows if k == "true"], [c for k, c in rows if k == "pred"]


def f1_score(cps: DataFrame, margin: float = 0.01) -> DataFrame:
    return _by_series(cps, lambda t: f1(*_kinds(t), margin), ["precision", "recall", "score"])


def gaussian_f1_score(cps: DataFrame, **how) -> DataFrame:
    return _by_series(cps, lambda t: gaussian_f1(*_kinds(t), **how), ["precision", "recall", "matched_weight", "score"])


def state_matching_score(labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    def one(table: pa.Table) -> dict[str, float]:
        table = table.sort_by("t")
        return {"score": state_matching(table["y_true"].to_numpy(), table["y_pred"].to_numpy(), weights)[0]}

    return _by_series(labels, one, ["score"])
