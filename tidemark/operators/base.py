"""Detectors as DataFrame -> DataFrame transformations: a series is a key, and a kernel sees one series at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import aggregate_change_points
from .params import Param, check

#: Longest series that a kernel with all pairs of its points takes.
MAX_PAIRS_POINTS = 5000
REGISTRY: dict[str, type[Detector]] = {}


class NotFittedError(ValueError):
    """predict() came before fit()."""


@dataclass
class Detector:
    """Parameters are fields; `kernel(x)` gets a series as an (n, channels) array and returns change points or labels.

    `dense` says which: labels, one a time step, or change points, each the first index of a new segment. transform()
    takes series(series_id, t, x array<double>), rows in any order, and gives (series_id, cp) or (series_id, t, state).
    Rows with a null x or a missing channel value are refused, as are series beyond `max_points`. A table
    params(series_id, ...) gives series their own values of the fields it names."""

    dense = False
    multivariate = True
    max_points: int | None = field(default=None, kw_only=True)
    PARAMS = ()

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        REGISTRY[cls.__name__] = cls

    def __post_init__(self):
        check(self)

    def kernel(self, x: np.ndarray):
        raise NotImplementedError

    def replace(self, **changes: Any) -> Detector:
        values = {k: v for k, v in self.get_params().items()} | changes
        return type(self)(**values)

    clone = replace

    def get_params(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    @classmethod
    def tags(cls) -> dict[str, Any]:
        return {"returns_dense": not cls.dense, "multivariate": cls.multivariate, "name": cls.__name__}

    def for_series(self, series_id: str | None) -> Detector:
        """The detector for one of many series; those that draw numbers draw others for each."""
        return self

    def _checked(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        x = x[:, None] if x.ndim == 1 else x
        if x.ndim != 2:
            raise ValueError("a series is (points,) or (points, channels)")
        if not np.isfinite(x).all():
            raise ValueError("a series has missing or infinite values")
        if not self.multivariate and x.shape[1] > 1:
            raise ValueError(f"{type(self).__name__} takes one channel")
        if self.max_points and len(x) > self.max_points:
            raise ValueError(f"{type(self).__name__} takes at most {self.max_points} points a series")
        return x

    def fit(self, x, y=None) -> Detector:
        """Takes a series' shape, and labels y of its points if there are any, as known; predict() then wants the same channels."""
        x = self._checked(x)
        if y is not None and np.shape(y) != (len(x),):
            raise ValueError("labels are one for each point")
        self._fitted = {"n_points": len(x), "n_channels": x.shape[1]}
        return self

    @property
    def is_fitted(self) -> bool:
        return getattr(self, "_fitted", None) is not None

    def reset(self) -> Detector:
        """Forgets what fit() took; parameters stay."""
        self._fitted = None
        return self

    def get_fitted_params(self) -> dict[str, Any]:
        if not self.is_fitted:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        return dict(self._fitted)

    def predict(self, x) -> np.ndarray:
        if self._checked(x).shape[1] != self.get_fitted_params()["n_channels"]:
            raise ValueError("the series has other channels than that of fit()")
        return self._found(self._checked(x))

    def fit_predict(self, x, y=None) -> np.ndarray:
        """The kernel on one series in memory, with the input checks that transform() makes."""
        return self.fit(x, y).predict(x)

    def _found(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0, int)
        out = self.kernel(x)
        if self.dense:
            return np.asarray(out, int)
        return np.array(sorted({int(c) for c in out if 0 < c < len(x)}), int)

    def transform(self, series: DataFrame, params: DataFrame | None = None) -> DataFrame:
        own = [c for c in (params.columns if params is not None else []) if c != "series_id"]
        rows = series.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"))
        if own:
            rows = rows.join(params.select(F.col("series_id").cast("string").alias("series_id"), *own), "series_id", "left")
        dense, this = self.dense, self

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("t")
            detector = this.replace(**{c: table[c][0].as_py() for c in own if table[c][0].as_py() is not None}) if own else this
            points = table["x"].combine_chunks()
            sizes, values = pc.unique(pc.list_value_length(points)), points.flatten()
            if points.null_count or values.null_count or len(sizes) > 1:
                raise ValueError(f"series {table['series_id'][0].as_py()!r} has missing values")
            out = detector.for_series(table["series_id"][0].as_py()).fit_predict(values.to_numpy().reshape(len(points), -1))
            ids = pa.array([table["series_id"][0].as_py()] * len(out), pa.string())
            if dense:
                return pa.table({"series_id": ids, "t": table["t"].combine_chunks(), "state": pa.array(out, pa.int32())})
            return pa.table({"series_id": ids, "cp": pa.array(out, pa.int64())})

        return rows.groupBy("series_id").applyInArrow(run, "series_id string, t long, state int" if dense else "series_id string, cp long")


def channels(x: np.ndarray, strategy: str, one: Callable[[np.ndarray], list[int]], tolerance: float, n_cps: int | None = None) -> list[int]:
    """A one-channel method on several channels: on their norm, or on each with the points put to a vote."""
    if x.shape[1] == 1:
        return one(x[:, 0])
    if strategy == "l2":
        return one(np.linalg.norm(x, axis=1))
    found = [one(x[:, c]) for c in range(x.shape[1])]
    wanted = n_cps if n_cps is not None else int(np.median([len(f) for f in found]))
    return aggregate_change_points([p for f in found for p in f], wanted, tolerance, len(x))


def parameter_schema(name: str) -> tuple[Param, ...]:
    return REGISTRY[name].PARAMS


def create(name: str, **params: Any) -> Detector:
    return REGISTRY[name](**params)


def names() -> Iterator[str]:
    yield from sorted(REGISTRY)
