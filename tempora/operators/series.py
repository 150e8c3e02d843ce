"""Forecasts, decompositions and multivariate models of many series: one Arrow-batched kernel call per series."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions import kernels as K
from tempora.functions.buckets import time_bucket
from tempora.session import ship


def _apply(rows: DataFrame, keys: list[str], columns: list[str], function, outputs: list[T.StructField]) -> DataFrame:
    ship(rows.sparkSession)
    fields = [rows.schema[k] for k in keys] + outputs
    used = rows.select(*dict.fromkeys([*keys, *columns]))
    return used.groupBy(*keys).applyInPandas(function, T.StructType(fields))


def forecast(rows: DataFrame, keys: list[str], time: str, value: str, horizon: int, model: str = "auto", step: str | None = None, max_points: int | None = None, **options) -> DataFrame:
    """(keys, step, time, value, lower, upper, parameters): the series continued at its median distance.

    Of repeated times the last value counts; nulls are left out; ``step`` averages into buckets first;
    ``max_points`` keeps the newest. A series the model refuses gives no rows.
    """
    if model not in ("auto", "conformal", *K.MODELS):
        raise ValueError(f"unknown model {model!r}; known: auto, conformal, {', '.join(K.MODELS)}")
    if step:
        rows = rows.groupBy(*keys, time_bucket(step, F.col(time)).alias(time)).agg(F.avg(value).alias(value))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({f.name: [] for f in fields})
        pdf = pdf.dropna(subset=[time, value]).sort_values(time, kind="stable").drop_duplicates(time, keep="last")
        pdf = pdf.tail(max_points) if max_points else pdf
        y = pdf[value].to_numpy(float)
        try:
            found = K.auto_forecast(y, horizon) if model == "auto" else K.conformal(y, horizon, **options) if model == "conformal" else K.MODELS[model](y, horizon, **options)
        except (ValueError, IndexError):
            return empty
        gap = pdf[time].diff().median()
        steps = np.arange(1, horizon + 1)
        made = {k: [pdf[k].iloc[0]] * horizon for k in keys}
        made |= {"step": steps, time: [pdf[time].iloc[-1] + gap * int(i) for i in steps], value: found.mean, "lower": found.lower, "upper": found.upper, "parameters": [json.dumps(found.parameters, default=str)] * horizon}
        return pd.DataFrame(made)

    fields = [rows.schema[k] for k in keys] + [T.StructField("step", T.LongType()), rows.schema[time], T.StructField(value, T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()), T.StructField("parameters", T.StringType())]
    return _apply(rows, keys, [time, value], run, fields[len(keys) :])


def _each_row(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], carried: list[str], names: list[str], kernel) -> DataFrame:
    """A kernel's arrays, one value per ordered row, beside the carried columns; null where the kernel refuses."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        try:
            made = kernel(*(pdf[c].to_numpy(float) for c in columns))
        except ValueError:
            made = [np.full(len(pdf), np.nan) for _ in names]
        return pdf[list(dict.fromkeys([*keys, *carried]))].assign(**dict(zip(names, made, strict=True)))

    outputs = [rows.schema[c] for c in carried] + [T.StructField(n, T.DoubleType()) for n in names]
    return _apply(rows, keys, [*order, *columns, *carried], run, outputs)


def _interpolated(y: np.ndarray) -> np.ndarray:
    at = np.arange(len(y))
    ok = ~np.isnan(y)
    if not ok.any():
        raise ValueError("no values")
    return np.interp(at, at[ok], y[ok])


def stl(rows: DataFrame, keys: list[str], order: list[str], value: str, period: int, robust: bool = False, carried: list[str] | None = None) -> DataFrame:
    """trend, seasonal and residual beside the carried columns; gaps are interpolated and stay null."""

    def kernel(y):
        gone = np.isnan(y)
        return [np.where(gone, np.nan, part) for part in K.stl(_interpolated(y), period, robust)]

    return _each_row(rows, keys, order, [value], carried or order, ["trend", "seasonal", "residual"], kernel)


def period(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    def run(pdf):
        found = K.detect_period(pdf.sort_values(order)[value].dropna().to_numpy(float))
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"period": [found]})

    return _apply(rows, keys, [*order, value], run, [T.StructField("period", T.LongType())])


def multivariate_scores(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], method: str = "mahalanobis", carried: list[str] | None = None, **options) -> DataFrame:
    """``score`` of each row among its series: mahalanobis, isolation_forest or pca."""
    kernels = {"mahalanobis": K.mahalanobis, "isolation_forest": K.isolation_scores, "pca": K.pca_error}
    if method not in kernels:
        raise ValueError(f"unknown method {method!r}")

    def kernel(*series):
        x = np.column_stack(series)
        ok = ~np.isnan(x).any(axis=1)
        if ok.sum() < 3:
            raise ValueError("three complete rows are needed")
        out = np.full(len(x), np.nan)
        out[ok] = kernels[method](x[ok], **options)
        return [out]

    return _each_row(rows, keys, order, columns, carried or order, ["score"], kernel)


def rank_correlations(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, pearson, spearman, kendall) of complete pairs."""

    def run(pdf):
        pdf = pdf.dropna(subset=[a, b])
        x, y = pdf[a].to_numpy(float), pdf[b].to_numpy(float)
        few = len(x) < 2
        made = {n: [np.nan if few else f(x, y)] for n, f in (("pearson", K.pearson), ("spearman", K.spearman), ("kendall", K.kendall))}
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | made) if len(pdf) else pd.DataFrame({f.name: [] for f in fields})

    fields = [rows.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in ("pearson", "spearman", "kendall")]
    return _apply(rows, keys, [a, b], run, fields[len(keys) :])


def var_forecast(wide: DataFrame, keys: list[str], order: list[str], columns: list[str], lags: int, horizon: int) -> DataFrame:
    """(keys, step, columns): a vector autoregression continued; no rows where it is not stable or too short."""
    fields = [wide.schema[k] for k in keys] + [T.StructField("step", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in columns]

    def run(pdf):
        x = pdf.sort_values(order)[columns].dropna().to_numpy(float)
        try:
            if len(x) < lags * len(columns) + lags + 3:
                raise ValueError("too short")
            ahead = K.var_model(x, lags, horizon)
        except ValueError:
            return pd.DataFrame({f.name: [] for f in fields})
        made = {k: [pdf[k].iloc[0]] * horizon for k in keys} | {"step": np.arange(1, horizon + 1)}
        return pd.DataFrame(made | {c: ahead[:, i] for i, c in enumerate(columns)})

    return _apply(wide, keys, [*order, *columns], run, fields[len(keys) :])


def granger(wide: DataFrame, keys: list[str], order: list[str], columns: list[str], lags: int) -> DataFrame:
    """(keys, cause, effect, f, p, p_adjusted) for all ordered pairs of columns, corrected by Benjamini and Hochberg."""
    outputs = [T.StructField("cause", T.StringType()), T.StructField("effect", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("f", "p", "p_adjusted"))]

    def run(pdf):
        x = pdf.sort_values(order)[columns].dropna()
        pairs = [(a, b) for a in columns for b in columns if a != b]
        if len(x) < 3 * lags + 3:
            return pd.DataFrame({n: [] for n in (*keys, *(o.name for o in outputs))})
        found = [K.granger(x[a].to_numpy(float), x[b].to_numpy(float), lags) for a, b in pairs]
        p = np.array([f[1] for f in found])
        made = {k: [pdf[k].iloc[0]] * len(pairs) for k in keys}
        return pd.DataFrame(made | {"cause": [a for a, _ in pairs], "effect": [b for _, b in pairs], "f": [f[0] for f in found], "p": p, "p_adjusted": K.benjamini_hochberg(p)})

    return _apply(wide, keys, [*order, *columns], run, outputs)
