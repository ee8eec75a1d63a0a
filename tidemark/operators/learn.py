"""Nuisance learners.  The native ones are additive sufficient statistics, so cross-fitting is total minus fold.

A learner is fitted on ``features`` (double columns) or ``cells`` (grouping columns) and then predicts any
number of designs.  With a ``fold`` column, a row's prediction never used its own fold.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StudyError
from ..functions.expr import clip, expit, indicator, lit, total
from ..sources.store import durable, local_frame

FOLD = "fold"


@dataclass(frozen=True)
class Task:
    """What to fit: target and weight on the rows where ``where`` holds; folds is the number of folds, 0 for none."""

    target: Column
    weight: Column
    where: Column | None = None
    folds: int = 0
    binary: bool = False

    def on(self, df: DataFrame) -> DataFrame:
        return df if self.where is None else df.where(self.where)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares solution where the system is singular."""
    try:
        if np.linalg.cond(a) < 1e12:
            return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(a) @ b


def _dot(coefficients: np.ndarray, features: Sequence[Column], folds: int) -> Column:
    """x'b with the coefficients of the row's fold: one array literal per feature."""
    x = [lit(1), *features]
    if not folds:
        return total(lit(c) * f for c, f in zip(coefficients[0], x, strict=True))
    pick = lambda j: F.element_at(F.array(*(lit(c) for c in coefficients[:, j])), F.col(FOLD) + 1)
    return total(pick(j) * f for j, f in enumerate(x))


#: Cells that are gathered once and handed to every executor; more are written and joined by a shuffle.
CELL_ROWS = 20_000


class CellMean:
    """Saturated regression: the weighted mean of each cell, out of fold where folds are given.

    A cell without rows elsewhere falls back on the margin of all other folds.
    """

    def fit(self, df: DataFrame, task: Task, features: Sequence[Column], cells: Sequence[Column]) -> _CellFit:
        names = [f"cell_{i}" for i in range(len(cells))]
        rows = task.on(df)
        keys = [c.alias(n) for c, n in zip(cells, names, strict=True)] + ([F.col(FOLD)] if task.folds else [])
        stats = rows.select(*keys, task.weight.alias("sw"), (task.weight * task.target).alias("swy"))
        by = names + ([FOLD] if task.folds else [])
        stats = stats.groupBy(*by).agg(F.sum("sw").alias("sw"), F.sum("swy").alias("swy"))
        found = stats.limit(CELL_ROWS + 1).collect()
        if len(found) <= CELL_ROWS:
            return _few_cells(stats, found, names, task.folds)
        stats = durable(stats, "cells")
        if not task.folds:
            margin = stats.agg(F.sum("swy") / F.sum("sw")).first()[0]
            return _CellFit(stats.select(*names, (F.col("swy") / F.col("sw")).alias("m")), names, lit(margin), False)
        byfold = {r[FOLD]: (r["sw"], r["swy"]) for r in stats.groupBy(FOLD).agg(F.sum("sw").alias("sw"), F.sum("swy").alias("swy")).collect()}
        margin = _by_fold(_margins(byfold, task.folds))
        # A map from fold to sums, so every cell knows what each fold added to it.
        cell = stats.groupBy(*names).agg(F.sum("sw").alias("tw"), F.sum("swy").alias("twy"), F.map_from_entries(F.collect_list(F.struct(FOLD, F.struct("sw", "swy")))).alias("own"))
        spread = cell.withColumn(FOLD, F.explode(F.sequence(F.lit(0), F.lit(task.folds - 1)))).withColumn("o", F.col("own")[F.col(FOLD)])
        left = F.col("tw") - F.coalesce(F.col("o.sw"), lit(0))
        mean = F.when(left > 1e-9 * F.col("tw"), (F.col("twy") - F.coalesce(F.col("o.swy"), lit(0))) / left)
        return _CellFit(durable(spread.select(*names, FOLD, mean.alias("m")), "cells"), names, margin, True)

    def shares(self, df: DataFrame, code: Column, levels: int, weight: Column, cells: Sequence[Column], outs: Sequence[str]) -> DataFrame:
        """Add the share of every level of ``code`` within each cell: one aggregate and one join for all levels."""
        names = [f"cell_{i}" for i in range(len(cells))]
        rows = df.select(*(c.alias(n) for c, n in zip(cells, names, strict=True)), code.alias("code__"), weight.alias("w__"))
        sums = [(F.sum(indicator(F.col("code__") == k) * F.col("w__")) / F.sum("w__")).alias(o) for k, o in enumerate(outs[:levels])]
        t = rows.groupBy(*names).agg(*sums)
        found = t.limit(CELL_ROWS + 1).collect()
        t = F.broadcast(local_frame(df.sparkSession, found, t.schema)) if len(found) <= CELL_ROWS else durable(t, "shares")
        if not names:
            return df.crossJoin(t)  # one row
        keyed = df.withColumns({n + "__k": c for n, c in zip(names, cells, strict=True)})
        joined = keyed.join(t, [keyed[n + "__k"].eqNullSafe(t[n]) for n in names])
        return joined.select(*(keyed[c] for c in df.columns), *(t[o] for o in outs))


def _margins(byfold: dict, folds: int) -> list[float]:
    """The mean over all other folds, for each fold."""
    w, wy = (sum(v[i] or 0.0 for v in byfold.values()) for i in (0, 1))
    return [(wy - (byfold.get(v, (0, 0))[1] or 0.0)) / max(w - (byfold.get(v, (0, 0))[0] or 0.0), 1e-300) for v in range(folds)]


def _by_fold(values: Sequence[float]) -> Column:
    return F.element_at(F.array(*(lit(m) for m in values)), F.col(FOLD) + 1)


def _few_cells(stats: DataFrame, found: list, names: list[str], folds: int) -> _CellFit:
    """The same from sums that have been gathered: the table of means is local, and is broadcast."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    spark, n = stats.sparkSession, len(names)
    fields = [StructField(f.name, f.dataType) for f in stats.schema.fields[:n]]
    if not folds:
        w, wy = (sum(r[k] or 0.0 for r in found) for k in ("sw", "swy"))
        rows = [(*r[:n], r["swy"] / r["sw"] if r["sw"] and r["swy"] is not None else None) for r in found]
        table = local_frame(spark, rows, StructType([*fields, StructField("m", DoubleType())]))
        return _CellFit(F.broadcast(table), names, lit(wy / w if w else 0.0), False)
    byfold: dict[int, tuple[float, float]] = {}
    cells: dict[tuple, dict[int, tuple[float, float]]] = {}
    for r in found:
        sw, swy = r["sw"] or 0.0, r["swy"] or 0.0
        held = byfold.get(r[FOLD], (0.0, 0.0))
        byfold[r[FOLD]] = (held[0] + sw, held[1] + swy)
        cells.setdefault(tuple(r[:n]), {})[r[FOLD]] = (sw, swy)
    rows = []
    for key, own in cells.items():
        tw, twy = (sum(v[i] for v in own.values()) for i in (0, 1))
        for v in range(folds):
            sw, swy = own.get(v, (0.0, 0.0))
            rows.append((*key, v, (twy - swy) / (tw - sw) if tw - sw > 1e-9 * tw else None))
    table = local_frame(spark, rows, StructType([*fields, StructField(FOLD, IntegerType()), StructField("m", DoubleType())]))
    return _CellFit(F.broadcast(table), names, _by_fold(_margins(byfold, folds)), True)


@dataclass(frozen=True)
class _CellFit:
    table: DataFrame
    names: list[str]
    margin: Column
    by_fold: bool

    def _joined(self, df: DataFrame, t: DataFrame, names: list[str], cells: Sequence[Column], outs: dict[str, Column]) -> DataFrame:
        """``df`` with columns of ``t`` joined on cells, nulls included, and on the fold; ``t`` has its fold as fold__t."""
        keyed = df.withColumns({n + "__k": c for n, c in zip(names, cells, strict=True)})
        on = [keyed[n + "__k"].eqNullSafe(t[n]) for n in names] + ([keyed[FOLD] == t["fold__t"]] if self.by_fold else [])
        joined = keyed.join(t, on, "left") if on else keyed.crossJoin(F.broadcast(t))  # one row when there are no cells
        return joined.select(*(keyed[c] for c in df.columns), *(c.alias(o) for o, c in outs.items()))

    def predict_arms(self, df: DataFrame, outs: Sequence[str], others: Sequence[Column]) -> DataFrame:
        """Predictions at arms 0, 1, .. of a fit whose first cell is the arm: one join, as arms of a cell are few."""
        rest = self.names[1:]
        keys = rest + ([FOLD] if self.by_fold else [])
        at = [F.max(F.when(F.col(self.names[0]) == k, F.col("m"))).alias(f"arm__{k}") for k in range(len(outs))]
        t = F.broadcast(self.table.groupBy(*keys).agg(*at)) if self._local() else self.table.groupBy(*keys).agg(*at)
        t = t.withColumnsRenamed({FOLD: "fold__t"})
        return self._joined(df, t, rest, others, {o: F.coalesce(F.col(f"arm__{k}"), self.margin) for k, o in enumerate(outs)})

    def predict(self, df: DataFrame, out: str, features: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
        t = self.table.withColumnsRenamed({"m": out + "__m", FOLD: "fold__t"})
        return self._joined(df, t, self.names, cells, {out: F.coalesce(F.col(out + "__m"), self.margin)})

    def _local(self) -> bool:
        return bool(self.table._jdf.queryExecution().logical().getClass().getSimpleName() == "ResolvedHint")


class LinearGram:
    """Weighted least squares from one aggregate of X'WX and X'Wy by fold."""

    def __init__(self, ridge: float = 0.0):
        self.ridge = ridge

    def fit(self, df: DataFrame, task: Task, features: Sequence[Column], cells: Sequence[Column]) -> _LinearFit:
        x = [lit(1), *features]
        p = len(x)
        sums = [F.sum(task.weight * x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(p) for j in range(i, p)]
        sums += [F.sum(task.weight * x[i] * task.target).alias(f"b_{i}") for i in range(p)]
        rows = task.on(df)
        found = rows.groupBy(FOLD).agg(*sums).collect() if task.folds else [rows.agg(*sums).first()]

        def system(r) -> tuple[np.ndarray, np.ndarray]:
            g = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    g[i, j] = g[j, i] = r[f"g_{i}_{j}"] or 0.0
            return g, np.array([r[f"b_{i}"] or 0.0 for i in range(p)])

        parts = {r[FOLD] if task.folds else 0: system(r) for r in found}
        g, b = (sum(v[i] for v in parts.values()) for i in (0, 1))
        ridge = self.ridge * np.diag([0.0, *np.ones(p - 1)])
        none = (np.zeros((p, p)), np.zeros(p))
        each = [solve(g - parts.get(v, none)[0] + ridge, b - parts.get(v, none)[1]) for v in range(task.folds)] if task.folds else [solve(g + ridge, b)]
        return _LinearFit(np.array(each), task.folds, False)

    def fit_all(self, df: DataFrame, tasks: Sequence[tuple[Task, Sequence[Column]]]) -> list[_LinearFit]:
        """``fit`` of several tasks with the same folds, from one aggregate."""
        folds, sums, sizes = tasks[0][0].folds, [], []
        for task, features in tasks:
            x = [lit(1), *features]
            w = task.weight if task.where is None else F.when(task.where, task.weight)
            upper = np.triu_indices(len(x))
            sums += [F.sum(w * x[i] * x[j]) for i, j in zip(*upper, strict=True)] + [F.sum(w * c * task.target) for c in x]
            sizes.append(len(x))
        found = df.groupBy(FOLD).agg(*sums).collect() if folds else [(0, *df.agg(*sums).first())]
        byfold = np.zeros((max(folds, 1), len(sums)))
        for r in found:
            byfold[r[0]] = [v or 0.0 for v in r[1:]]
        use = byfold.sum(axis=0) - byfold if folds else byfold
        out, at = [], 0
        for p in sizes:
            upper, many = np.triu_indices(p), p * (p + 1) // 2
            each = []
            for row in use[:, at : at + many + p]:
                g = np.zeros((p, p))
                g[upper] = row[:many]
                each.append(solve(g + np.triu(g, 1).T + self.ridge * np.diag([0.0, *np.ones(p - 1)]), row[many:]))
            out.append(_LinearFit(np.array(each), folds, False))
            at += many + p
        return out

    def fit_pairs(self, df: DataFrame, task: Task, features: Sequence[Column]) -> dict[tuple[int, int], np.ndarray]:
        """Coefficients without two folds at a time, {(v, u): b} for v > u: the whole less the sums of both, from one aggregate."""
        x = [lit(1), *features]
        p = len(x)
        sums = [F.sum(task.weight * x[i] * x[j]) for i in range(p) for j in range(i, p)] + [F.sum(task.weight * x[i] * task.target) for i in range(p)]
        parts = {}
        for r in task.on(df).groupBy(FOLD).agg(*sums).collect():
            g = np.zeros((p, p))
            g[np.triu_indices(p)] = [v or 0.0 for v in r[1 : 1 + p * (p + 1) // 2]]
            parts[r[0]] = (g + np.triu(g, 1).T, np.array([v or 0.0 for v in r[1 + p * (p + 1) // 2 :]]))
        whole = [sum(v[i] for v in parts.values()) for i in (0, 1)]
        none = (np.zeros((p, p)), np.zeros(p))
        left = lambda v, u, i: whole[i] - parts.get(v, none)[i] - parts.get(u, none)[i]
        return {(v, u): solve(left(v, u, 0), left(v, u, 1)) for v in range(task.folds) for u in range(v)}


def companion(model: Any, extra: DataFrame, folds: int, out: str, features: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
    """Rows that no fold holds, once for every fold, with the prediction of the model that left that fold out."""
    each = extra.withColumn(FOLD, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return model.predict(each, out, features, cells)


@dataclass(frozen=True)
class _LinearFit:
    coefficients: np.ndarray
    folds: int
    logistic: bool

    def column(self, features: Sequence[Column]) -> Column:
        eta = _dot(self.coefficients, features, self.folds)
        return expit(eta) if self.logistic else eta

    def predict(self, df: DataFrame, out: str, features: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
        return df.withColumn(out, self.column(features))


#: Sums of one step that Spark's own expressions take; beyond that a step runs on Arrow batches.
EXPRESSION_SUMS = 400


class LogisticNewton:
    """Logistic regression by Newton steps; the models of all folds advance in one pass per step.

    Few sums are one aggregate of column expressions.  Many (folds times squared features) would outgrow generated
    code, so each task then adds up its batches with matrix products and emits one row.
    """

    def __init__(self, steps: int = 25, tol: float = 1e-10, ridge: float = 1e-8):
        self.steps, self.tol, self.ridge = steps, tol, ridge

    def fit(self, df: DataFrame, task: Task, features: Sequence[Column], cells: Sequence[Column]) -> _LinearFit:
        rows = task.on(df).select(*(f.cast("double").alias(f"f_{i}") for i, f in enumerate(features)), task.target.cast("double").alias("t"), task.weight.cast("double").alias("v"), *([F.col(FOLD)] if task.folds else []))
        rows = rows.persist()
        p, models = len(features) + 1, max(task.folds, 1)
        beta = np.zeros((models, p))
        upper = np.triu_indices(p)
        sums = _by_expressions if models * (p + len(upper[0])) <= EXPRESSION_SUMS else _by_batches
        try:
            for _ in range(self.steps):
                r = sums(rows, beta, bool(task.folds))
                move = np.zeros_like(beta)
                for m in range(models):
                    h = np.zeros((p, p))
                    h[upper] = r[m, p:]
                    h = h + np.triu(h, 1).T + self.ridge * np.eye(p)
                    move[m] = np.clip(solve(h, r[m, :p] - self.ridge * beta[m]), -5, 5)
                beta = beta + move
                if np.abs(move).max() < self.tol:
                    break
        finally:
            rows.unpersist()
        return _LinearFit(beta, task.folds, True)


def _by_expressions(rows: DataFrame, beta: np.ndarray, folds: bool) -> np.ndarray:
    """Gradient and upper Hessian of every model, as one aggregate."""
    models, p = beta.shape
    x = [lit(1), *(F.col(f"f_{i}") for i in range(p - 1))]
    sums = []
    for m in range(models):
        keep = F.col("v") * (indicator(F.col(FOLD) != m) if folds else lit(1))
        q = expit(total(lit(c) * f for c, f in zip(beta[m], x, strict=True)))
        sums += [F.sum(keep * f * (F.col("t") - q)) for f in x]
        sums += [F.sum(keep * q * (lit(1) - q) * x[i] * x[j]) for i in range(p) for j in range(i, p)]
    return np.array([v or 0.0 for v in rows.agg(*sums).first()], float).reshape(models, -1)


def _by_batches(rows: DataFrame, beta: np.ndarray, folds: bool) -> np.ndarray:
    """The same from one row per task, added up by place."""
    models, p = beta.shape
    upper = np.triu_indices(p)

    def run(batches):
        import pyarrow as pa

        out = np.zeros((models, p + len(upper[0])))
        for batch in batches:
            held = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            x = np.column_stack([np.ones(len(batch)), *held[: p - 1]])
            t, v = held[p - 1], held[p]
            for m in range(models):
                w = v * (held[p + 1] != m) if folds else v
                q = 1 / (1 + np.exp(-np.clip(x @ beta[m], -500, 500)))
                out[m, :p] += x.T @ (w * (t - q))
                out[m, p:] += ((x * (w * q * (1 - q))[:, None]).T @ x)[upper]
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["s"])

    parts = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v"))
    flat = np.zeros(models * (p + len(upper[0])))
    for r in parts.collect():  # a number for each sum
        flat[r["pos"]] = r["v"]
    return flat.reshape(models, -1)


class MLlib:
    """Any MLlib estimator: fitted once per fold on the other folds, transformed on its own."""

    def __init__(self, estimator: Any, binary: bool = False):
        self.estimator, self.binary = estimator, binary

    def fit(self, df: DataFrame, task: Task, features: Sequence[Column], cells: Sequence[Column]) -> _MLlibFit:
        from pyspark.ml.feature import VectorAssembler

        names = [f"f_{i}" for i in range(len(features))]
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        rows = task.on(df).select(*(f.alias(n) for f, n in zip(features, names, strict=True)), task.target.alias("label"), task.weight.alias("weight"), *([F.col(FOLD)] if task.folds else []))
        rows = assembler.transform(rows).persist()
        e = self.estimator.copy()
        if e.hasParam("weightCol"):
            e = e.copy({e.weightCol: "weight"})
        models = [e.fit(rows.where(F.col(FOLD) != v)) for v in range(task.folds)] if task.folds else [e.fit(rows)]
        rows.unpersist()
        return _MLlibFit(models, assembler, self.binary, task.folds)


@dataclass(frozen=True)
class _MLlibFit:
    models: list
    assembler: Any
    binary: bool
    folds: int

    def predict(self, df: DataFrame, out: str, features: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        names = self.assembler.getInputCols()
        rows = self.assembler.transform(df.withColumns(dict(zip(names, features, strict=True))))
        value = vector_to_array("probability")[1] if self.binary else F.col("prediction")
        done = None
        for v, model in enumerate(self.models):
            part = model.transform(rows.where(F.col(FOLD) == v) if self.folds else rows).select(*df.columns, value.alias(out))
            done = part if done is None else done.unionByName(part)
        return done


class SuperLearner:
    """A convex combination of learners, weighted by their inner out-of-fold predictions.

    The weights minimise squared error (non-negative least squares on the Gram matrix of predictions, put on the
    simplex) or, for binary targets, the negative log-likelihood by exponentiated gradient, one aggregate a step.
    A candidate that fails is dropped.  With outer folds, weights are found inside each training part.
    """

    def __init__(self, library: Sequence[tuple[str, Any]], inner_folds: int = 5, loss: str = "auto", steps: int = 60):
        self.library, self.inner_folds, self.loss, self.steps = list(library), inner_folds, loss, steps

    def fit(self, df: DataFrame, task: Task, features: Sequence[Column], cells: Sequence[Column]) -> _SuperFit:
        parts = range(task.folds) if task.folds else [None]
        fits = []
        for v in parts:
            outside = None if v is None else F.col(FOLD) != v
            where = task.where if outside is None else outside if task.where is None else task.where & outside
            fits.append(self._fit_one(df, Task(task.target, task.weight, where, 0, task.binary), features, cells))
        return _SuperFit(fits, task.folds)

    def _fit_one(self, df: DataFrame, task: Task, features: Sequence[Column], cells: Sequence[Column]) -> tuple[np.ndarray, list, list[str], list[float]]:
        from .folds import hash32

        names = []
        rows = task.on(df)
        rows = rows.withColumn(FOLD, (hash32(F.col("id"), 7919) % self.inner_folds).cast("int"))
        z = rows
        for name, learner in self.library:
            try:
                z = learner.fit(rows, Task(task.target, task.weight, None, self.inner_folds, task.binary), features, cells).predict(z, f"z_{len(names)}", features, cells)
                names.append((name, learner))
            except (StudyError, np.linalg.LinAlgError, PySparkException, Py4JError) as why:
                warnings.warn(f"the candidate {name!r} failed and is dropped: {str(why)[:200]}", stacklevel=2)
        if not names:
            raise StudyError("every candidate failed")
        z = z.persist()
        k = len(names)
        weights = self._nll(z, task, k) if task.binary and self.loss in ("auto", "nll") else self._nnls(z, task, k)
        risks = self._risks(z, task, weights)
        z.unpersist()
        whole = [learner.fit(rows, Task(task.target, task.weight, None, 0, task.binary), features, cells) for _, learner in names]
        return weights, whole, [n for n, _ in names], risks

    @staticmethod
    def _risks(z: DataFrame, task: Task, weights: np.ndarray) -> list[float]:
        """Cross-validated squared error of every candidate, and of their combination last."""
        k = len(weights)
        mixed = total(lit(c) * F.col(f"z_{i}") for i, c in enumerate(weights))
        r = z.agg(F.sum(task.weight), *(F.sum(task.weight * (task.target - p) ** 2) for p in [*(F.col(f"z_{i}") for i in range(k)), mixed])).first()
        return [v / r[0] for v in r[1:]]

    @staticmethod
    def _nnls(z: DataFrame, task: Task, k: int) -> np.ndarray:
        sums = [F.sum(task.weight * F.col(f"z_{i}") * F.col(f"z_{j}")) for i in range(k) for j in range(k)] + [F.sum(task.weight * F.col(f"z_{i}") * task.target) for i in range(k)]
        r = np.array(list(z.agg(*sums).first()), float)
        return simplex(nnls(r[: k * k].reshape(k, k), r[k * k :]))

    def _nll(self, z: DataFrame, task: Task, k: int) -> np.ndarray:
        w = np.full(k, 1 / k)
        for _ in range(self.steps):
            p = clip(total(lit(c) * clip(F.col(f"z_{i}"), 1e-6, 1 - 1e-6) for i, c in enumerate(w)), 1e-9, 1 - 1e-9)
            slope = task.weight * (task.target - p) / (p * (lit(1) - p))
            g = np.array(list(z.agg(*(F.sum(slope * clip(F.col(f"z_{i}"), 1e-6, 1 - 1e-6)) for i in range(k)), F.sum(task.weight)).first()), float)
            new = w * np.exp(np.clip(g[:k] / g[k], -20, 20))
            new /= new.sum()
            if np.abs(new - w).max() < 1e-6:
                return new
            w = new
        return w


@dataclass(frozen=True)
class _SuperFit:
    fits: list
    folds: int

    def risk_frame(self, spark: Any) -> DataFrame:
        """(fold, candidate, weight, risk) by outer fold, -1 where there are none; the combination's own risk has no weight."""
        rows = [(v if self.folds else -1, n, w, r) for v, (weights, _, names, risks) in enumerate(self.fits) for n, w, r in zip([*names, "combination"], [*map(float, weights), None], risks, strict=True)]
        return spark.createDataFrame(rows, "fold int, candidate string, weight double, risk double")

    def predict(self, df: DataFrame, out: str, features: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
        done = None
        for v, (weights, learners, _, _) in enumerate(self.fits):
            part = df.where(F.col(FOLD) == v) if self.folds else df
            for i, learner in enumerate(learners):
                part = learner.predict(part, f"sl__{i}", features, cells)
            part = part.select(*df.columns, total(lit(c) * F.col(f"sl__{i}") for i, c in enumerate(weights)).alias(out))
            done = part if done is None else done.unionByName(part)
        return done


def nnls(gram: np.ndarray, moment: np.ndarray, rounds: int = 500) -> np.ndarray:
    """argmin x'Gx - 2 m'x over x >= 0 by coordinate descent, which converges for a Gram matrix."""
    x = np.zeros(len(moment))
    for _ in range(rounds):
        before = x.copy()
        for i in range(len(x)):
            if gram[i, i] > 0:
                x[i] = max(0.0, x[i] + (moment[i] - gram[i] @ x) / gram[i, i])
        if np.abs(x - before).max() < 1e-12:
            break
    return x


def simplex(x: np.ndarray) -> np.ndarray:
    return x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))


def default_library(binary: bool) -> list[tuple[str, Any]]:
    """Boosting, a forest, a penalised and a plain generalised linear model."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    if binary:
        return [("boosting", MLlib(C.GBTClassifier(maxIter=20, seed=1), True)), ("forest", MLlib(C.RandomForestClassifier(seed=1), True)), ("lasso", MLlib(C.LogisticRegression(elasticNetParam=1.0, regParam=0.01), True)), ("glm", LogisticNewton())]
    return [("boosting", MLlib(R.GBTRegressor(maxIter=20, seed=1))), ("forest", MLlib(R.RandomForestRegressor(seed=1))), ("lasso", MLlib(R.LinearRegression(elasticNetParam=1.0, regParam=0.01))), ("glm", LinearGram())]


#: Learners by name: a factory from whether the target is binary.
LEARNERS: dict[str, Any] = {
    "cells": lambda binary: CellMean(),
    "glm": lambda binary: LogisticNewton() if binary else LinearGram(),
    "super": lambda binary: SuperLearner(default_library(binary), 3),
}


def register_learner(name: str, factory: Any, *, replace: bool = False) -> None:
    """Make a learner known by a name that configurations may use."""
    if name in LEARNERS and not replace:
        raise StudyError(f"the learner {name!r} is registered already")
    LEARNERS[name] = factory


def resolve_learner(given: Any, binary: bool) -> Any:
    """A learner from an object, a name, or nothing, which is a generalised linear model."""
    if given is None or isinstance(given, str):
        name = given or "glm"
        if name not in LEARNERS:
            raise StudyError(f"no learner {name!r}; there are {sorted(LEARNERS)}")
        return LEARNERS[name](binary)
    return given


# Screening.


def correlations(df: DataFrame, y: Column, names: Sequence[str], weight: Column) -> dict[str, float]:
    """Weighted correlation of each column with the target, from one aggregate."""
    sums = [F.sum(weight), F.sum(weight * y), F.sum(weight * y * y)]
    for c in names:
        sums += [F.sum(weight * F.col(c)), F.sum(weight * F.col(c) ** 2), F.sum(weight * F.col(c) * y)]
    r = list(df.agg(*sums).first())
    w, my, vy = r[0], r[1] / r[0], r[2] / r[0] - (r[1] / r[0]) ** 2
    out = {}
    for i, c in enumerate(names):
        mx, xx, xy = (v / w for v in r[3 + 3 * i : 6 + 3 * i])
        vx = xx - mx * mx
        out[c] = (xy - mx * my) / math.sqrt(vx * vy) if vx > 1e-300 and vy > 1e-300 else 0.0
    return out


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-min(x, 1 - 1e-16)))

    def fraction(a: float, b: float, x: float) -> float:
        c, d, h = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
        h = d
        for m in range(1, 300):
            up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / (1 + up * d), 1 + up / c
            h *= d * c
            down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / (1 + down * d), 1 + down / c
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(a, b, x) / a)
    return max(0.0, 1 - front * fraction(b, a, 1 - x) / b)


def screen(df: DataFrame, y: Column, names: Sequence[str], weight: Column, n: int, threshold: float = 0.1, min_retain: int | None = None) -> list[str]:
    """Columns whose correlation has a p-value below the threshold, and the strongest others up to ``min_retain``."""
    r = correlations(df, y, names, weight)
    floor = len(names) if min_retain is None else min_retain
    p = {c: t_two_sided(v * math.sqrt((n - 2) / max(1 - v * v, 1e-12)), n - 2) for c, v in r.items()}
    kept = [c for c in names if p[c] < threshold]
    rest = sorted((c for c in names if c not in kept), key=lambda c: -abs(r[c]))
    return kept + rest[: max(0, floor - len(kept))]
