"""Filling missing values from similar records: low-rank alternating least squares.

A record is a row of cells: its numeric fields (asinh, as scaled deviations from the median of the
entity's other values or, without any, from the field's centre), the entity's latest earlier and next
later value in the same form, further context fields and one-hot cells of categorical fields. Observed
cells are factorised as record factors times feature factors. Given the feature factors, records solve
their own small systems independently, in numpy over Arrow batches; given the record factors, a feature's
normal equations are sums over all records, of which every task emits one partial set and Spark adds
them up. One-hot cells are kept as codes: the levels of a field share one matrix, and each record adds
only to its own level. Only features x (rank^2 + rank) numbers ever reach the driver, whatever the number
of records. A twentieth of the known cells of the fields, by hash, is kept out of the fit; on it the
share of the predicted deviation that is believed is calibrated per field, down to none where cells tell
nothing about each other. Missing cells are decoded to valid values: numbers within the field's
observed range, categories by their highest cell. Every cell keeps its imputation flag and the period
of the latest earlier value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarterloom.session import ship, written

#: Categorical fields with more levels than this are refused (one cell each).
MAX_LEVELS = 4096


def usable(c: Column, low: float, high: float) -> Column:
    """The value if it is a finite number within [low, high], else NULL."""
    return F.when(~F.isnan(c) & c.between(low, high), c)


#: One in so many known cells of a field is held out of the fit.
HELD_OUT = 20


class _Cells:
    """How a record's columns become cells, and back."""

    def __init__(self, numeric: list[str], anchors: dict[str, str], mean: np.ndarray, sd: np.ndarray, step: np.ndarray, levels: dict[str, list], weight: float) -> None:
        self.numeric, self.anchors, self.mean, self.sd, self.step, self.levels = numeric, anchors, mean, sd, step, levels
        self.weight, self.d = weight, len(numeric) + sum(map(len, levels.values()))
        at = np.cumsum([len(numeric), *map(len, levels.values())])
        self.places = {c: slice(int(i), int(j)) for c, i, j in zip(levels, at, at[1:])}

    def column(self, b: pa.RecordBatch, c: str) -> np.ndarray:
        return b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def anchor(self, b: pa.RecordBatch, j: int) -> tuple[np.ndarray, np.ndarray]:
        """What a cell deviates from and the scale of that: the median of the entity's other values and the usual
        distance from it, else the field's centre and spread."""
        at, scale = np.full(b.num_rows, self.mean[j]), np.full(b.num_rows, self.sd[j])
        if (c := self.anchors.get(self.numeric[j])) is not None:
            v = self.column(b, c)
            ok = np.isfinite(v)
            at[ok], scale[ok] = np.arcsinh(v[ok]), self.step[j]
        return at, scale

    def encode(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Values and presence (1 or 0) of numeric cells, and the codes of categorical ones (-1: missing)."""
        x = np.zeros((b.num_rows, len(self.numeric)))
        m = np.zeros_like(x)
        for j, c in enumerate(self.numeric):
            v = self.column(b, c)
            ok = np.isfinite(v)
            at, scale = self.anchor(b, j)
            x[ok, j] = (np.arcsinh(v[ok]) - at[ok]) / scale[ok]
            m[ok, j] = 1
        codes = {}
        for c, values in self.levels.items():
            col = b.column(b.schema.get_field_index(c))
            codes[c] = pc.fill_null(pc.index_in(col, pa.array(values, col.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return x, m, codes

    def held(self, b: pa.RecordBatch, n: int) -> np.ndarray:
        """Which of the first ``n`` cells are held out of the fit, if they are known."""
        h = b.column(b.schema.get_field_index("__hash")).to_numpy()
        return (h[:, None] // HELD_OUT + 7 * np.arange(n) + h[:, None]) % HELD_OUT == 0

    def records(self, x: np.ndarray, m: np.ndarray, codes: dict[str, np.ndarray], v: np.ndarray, reg: float) -> np.ndarray:
        """The record factors of least squares, given the feature factors."""
        n, r = len(self.numeric), v.shape[1]
        a = (m @ (v[:n, :, None] * v[:n, None, :]).reshape(n, r * r)).reshape(-1, r, r) + reg * np.eye(r)
        b = (m * x) @ v[:n]
        for c, code in codes.items():
            own = v[self.places[c]]
            if len(own):
                known = code >= 0
                a += self.weight * known[:, None, None] * (own.T @ own)
                b += self.weight * known[:, None] * own[np.maximum(code, 0)]
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]

    def sums(self, x: np.ndarray, m: np.ndarray, codes: dict[str, np.ndarray], u: np.ndarray) -> np.ndarray:
        """The batch's part of the features' normal equations, flat: matrices of numeric cells and one of each
        categorical field, then the right sides of all cells."""
        r = u.shape[1]
        uu = (u[:, :, None] * u[:, None, :]).reshape(-1, r * r)
        a, right = [m.T @ uu], np.zeros((self.d, r))
        right[: len(self.numeric)] = (m * x).T @ u
        for c, code in codes.items():
            known = code >= 0
            a.append(self.weight * uu[known].sum(axis=0, keepdims=True))
            np.add.at(right, self.places[c].start + code[known], self.weight * u[known])
        return np.concatenate([*[y.ravel() for y in a], right.ravel()])

    def features(self, sums: np.ndarray, r: int, reg: float) -> np.ndarray:
        n, k = len(self.numeric), len(self.numeric) + len(self.levels)
        a = sums[: k * r * r].reshape(k, r, r)
        rows = np.concatenate([np.arange(n), *[np.full(len(x), n + i) for i, x in enumerate(self.levels.values())]]).astype(int)
        return np.linalg.solve(a[rows] + reg * np.eye(r), sums[k * r * r :].reshape(self.d, r, 1))[:, :, 0]


def _median_of_others(all_: Column, own: Column) -> Column:
    """The median of a sorted array without one occurrence of ``own`` (of all of it where ``own`` is NULL); NULL if none is left."""
    gone = F.coalesce(F.array_position(all_, own), F.lit(2**31 - 1))
    m = F.size(all_) - F.when(own.isNotNull(), 1).otherwise(0)
    at = lambda i: F.get(all_, (i + F.when(i + 1 >= gone, 1).otherwise(0)).cast("int"))
    return F.when(m > 0, (at(F.floor((m - 1) / 2)) + at(F.floor(m / 2))) / 2)


@dataclass
class _Factors:
    """The fitted feature factors, how cells are coded and decoded, and how much of a prediction is believed."""

    names: list[str]
    coding: _Cells
    low: list
    high: list
    reg: float
    factors: np.ndarray
    belief: np.ndarray

    def guess(self, b: pa.RecordBatch, hide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numeric cells, their presence, predicted deviations and record factors; ``hide``: without the held-out cells."""
        x, m, codes = self.coding.encode(b)
        n, seen = len(self.names), m.copy()
        if hide:
            seen[:, :n][self.coding.held(b, n)] = 0
        u = self.coding.records(x, seen, codes, self.factors, self.reg)
        return x, m, u @ self.factors[:n].T, u

    def value(self, b: pa.RecordBatch, j: int, g: np.ndarray) -> np.ndarray:
        """The decoded value of a field from its predicted deviation."""
        start, scale = self.coding.anchor(b, j)
        return np.clip(np.sinh(np.clip(g[:, j] * self.belief[j] * scale + start, -700, 700)), self.low[j], self.high[j])


def _cells(
    df: DataFrame, entity: str, period: str, fields: Mapping[str, tuple[float, float]], context: Mapping[str, tuple[float, float]], cats: list[str], rank: int, rounds: int, reg: float, seed: int
) -> tuple[DataFrame, _Factors]:
    """The cells of all records, written, and the factors fitted to them."""
    ship(df.sparkSession)
    names = list(fields)
    base = df.filter(F.col(entity).isNotNull() & F.col(period).isNotNull())
    rest = [c for c in cats if c not in (entity, period)]
    picked = [usable(F.col(c).cast("double"), *b).alias(c) for c, b in {**fields, **context}.items()]
    one = base.select(entity, period, F.struct(*picked, *rest).alias("__s")).groupBy(entity, period).agg(F.max("__s").alias("__s")).select(entity, period, "__s.*")
    w = W.partitionBy(entity).orderBy(period)  # one row per period of an entity
    pair = {f: F.when(F.col(f).isNotNull(), F.struct(F.col(period).alias("p"), F.col(f).alias("v"))) for f in names}
    cells = one.select(
        "*",
        *[F.last(pair[f], ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias(f"__last_{f}") for f in names],
        *[F.first(f, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias(f"__lead_{f}") for f in names],
        *[F.collect_list(f).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"__all_{f}") for f in names],
    )
    cells = cells.select("*", *[F.sort_array(f"__all_{f}").alias(f"__sorted_{f}") for f in names]).select(
        *one.columns, *[F.col(f"__last_{f}.p").alias(f"{f}_from") for f in names], *[F.col(f"__last_{f}.v").alias(f"__lag_{f}") for f in names], *[f"__lead_{f}" for f in names],
        *[_median_of_others(F.col(f"__sorted_{f}"), F.col(f)).alias(f"__mid_{f}") for f in names], F.pmod(F.xxhash64(entity, period), F.lit(2**31)).alias("__hash"),
    )
    cells = written(cells, "cells")

    near = [*[f"__lag_{f}" for f in names], *[f"__lead_{f}" for f in names]]
    columns = [*names, *context, *near]
    anchors = {c: f"__mid_{f}" for f in names for c in (f, f"__lag_{f}", f"__lead_{f}")}
    mean, sd, low, high, step = _statistics(cells, columns, anchors)
    levels = {}
    for c in cats:
        found = cells.select(c).filter(F.col(c).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        levels[c] = sorted(r[0] for r in found)
    model = _Factors(names, _Cells(columns, anchors, mean, sd, step, levels, weight=0.5), low, high, reg, np.zeros((0, rank)), np.zeros(len(names)))
    model.factors = _fit(cells, model, rank, rounds, seed)
    model.belief = _calibrate(cells, model)
    return cells, model


def _statistics(cells: DataFrame, columns: list[str], anchors: dict[str, str]) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray]:
    """Of every column, in one pass: mean and sd of its asinh (0 and 1 without values or variation), its least and greatest value
    (None without values), and the sd of the asinh's distance from its anchor (else 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, lo, hi = np.zeros((len(columns), 6)), np.full(len(columns), np.inf), np.full(len(columns), -np.inf)
        for b in batches:
            for j, c in enumerate(columns):
                v = b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = np.arcsinh(v[np.isfinite(v)])
                s[j, :3] += len(x), x.sum(), (x * x).sum()
                lo[j], hi[j] = min(lo[j], v[np.isfinite(v)].min(initial=np.inf)), max(hi[j], v[np.isfinite(v)].max(initial=-np.inf))
                if c in anchors:
                    a = b.column(b.schema.get_field_index(anchors[c])).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    ok = np.isfinite(v) & np.isfinite(a)
                    d = np.arcsinh(v[ok]) - np.arcsinh(a[ok])
                    s[j, 3:] += len(d), d.sum(), (d * d).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns))), *map(pa.array, s.T), pa.array(lo), pa.array(hi)], ["i", *[f"s{i}" for i in range(6)], "lo", "hi"])

    sums, low, high = np.zeros((len(columns), 6)), [None] * len(columns), [None] * len(columns)
    got = cells.mapInArrow(run, "i long, " + ", ".join(f"s{i} double" for i in range(6)) + ", lo double, hi double")
    for r in got.groupBy("i").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)], F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        sums[r["i"]] = [r[f"s{i}"] for i in range(6)]
        if r["s0"]:
            low[r["i"]], high[r["i"]] = r["lo"], r["hi"]

    def spread(n: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = x / np.maximum(n, 1)
        v = q / np.maximum(n, 1) - m * m
        return m, np.where(v > 1e-12, np.sqrt(np.maximum(v, 0)), 1.0)

    mean, sd = spread(*sums[:, :3].T)
    return mean, sd, low, high, spread(*sums[:, 3:].T)[1]


def _gather(cells: DataFrame, one: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of what ``one`` gives for every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(size)
        for b in batches:
            s += one(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(s)], ["i", "s"])

    total = np.zeros(size)
    for row in cells.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[row["i"]] = row["s"]
    return total


def _fit(cells: DataFrame, model: _Factors, rank: int, rounds: int, seed: int) -> np.ndarray:
    coding, reg, n = model.coding, model.reg, len(model.names)
    v = np.random.default_rng(seed).normal(scale=0.5, size=(coding.d, rank))
    size = (len(coding.numeric) + len(coding.levels)) * rank * rank + coding.d * rank
    for _ in range(rounds if coding.d else 0):

        def one(b: pa.RecordBatch, v: np.ndarray = v) -> np.ndarray:
            x, m, codes = coding.encode(b)
            m[:, :n][coding.held(b, n)] = 0
            return coding.sums(x, m, codes, coding.records(x, m, codes, v, reg))

        v = coding.features(_gather(cells, one, size), rank, reg)
    return v


def _calibrate(cells: DataFrame, model: _Factors) -> np.ndarray:
    """Per field the factor, from 0 to 1, by which predictions of the held-out cells fit best."""
    n = len(model.names)

    def one(b: pa.RecordBatch) -> np.ndarray:
        x, m, g, _ = model.guess(b, hide=True)
        use = model.coding.held(b, n) & (m[:, :n] > 0)
        t = np.clip(x[:, :n], -3, 3)  # so that a few odd values do not decide
        return np.concatenate([(use * t * g).sum(axis=0), (use * g * g).sum(axis=0)])

    s = _gather(cells, one, 2 * n) if n else np.zeros(0)
    return np.clip(np.divide(s[:n], s[n:], out=np.zeros(n), where=s[n:] > 0), 0.0, 1.0)


def als_impute(
    df: DataFrame,
    entity: str,
    period: str,
    fields: Mapping[str, tuple[float, float]],
    context: Mapping[str, tuple[float, float]] | None = None,
    categorical: Sequence[str] = (),
    fill_categorical: Sequence[str] = (),
    rank: int = 4,
    rounds: int = 6,
    reg: float = 0.3,
    seed: int = 7,
) -> DataFrame:
    """Completed records: entity, period, and for each of ``fields`` the columns f (double), f_filled,
    f_from (the latest earlier period of the entity with a usable value, or NULL); for each of
    ``fill_categorical`` the columns c and c_filled.

    ``fields`` and ``context`` give the range of usable numbers; NULL, NaN, infinities and values
    outside are missing. ``entity`` and ``period`` identify a record: rows without either are left
    out, of repeated ones the greatest is taken. A field without a usable value in the whole table
    stays NULL, with its flags set; one without variation is filled with that value. A record without
    any observed cell gets the fields' centres. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    cats = list(dict.fromkeys([*categorical, *fill_categorical]))
    cells, model = _cells(df, entity, period, fields, dict(context or {}), cats, rank, rounds, reg, seed)
    coding, names, kept = model.coding, list(fields), list(fill_categorical)
    out = T.StructType(
        [cells.schema[entity], cells.schema[period]]
        + [x for f in names for x in (T.StructField(f, T.DoubleType()), T.StructField(f"{f}_filled", T.BooleanType()), T.StructField(f"{f}_from", cells.schema[period].dataType))]
        + [x for c in kept for x in (cells.schema[c], T.StructField(f"{c}_filled", T.BooleanType()))]
    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, m, g, u = model.guess(batch, hide=False)
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            done = {entity: col(entity), period: col(period)}
            for j, f in enumerate(names):
                missing = m[:, j] == 0
                if model.low[j] is None:
                    done[f] = pa.nulls(batch.num_rows, pa.float64())
                else:
                    done[f] = pa.array(np.where(missing, model.value(batch, j, g), col(f).to_numpy(zero_copy_only=False)))
                done[f"{f}_filled"], done[f"{f}_from"] = pa.array(missing), col(f"{f}_from")
            for c in kept:
                done[c], done[f"{c}_filled"] = _filled_categories(col(c), coding.levels[c], u, model.factors[coding.places[c]])
            yield pa.RecordBatch.from_arrays([done[f.name].cast(f.type) for f in schema], schema=schema)

    return cells.mapInArrow(complete, out)


def _filled_categories(col: pa.Array, values: list, u: np.ndarray, v: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Missing categories by the highest cell, a thousand records at a time."""
    missing = col.is_null().to_numpy(zero_copy_only=False)
    if not values or not missing.any():
        return col, pa.array(missing)
    code = np.zeros(len(col), np.int64)
    rows = np.flatnonzero(missing)
    for at in range(0, len(rows), 1024):
        some = rows[at : at + 1024]
        code[some] = (u[some] @ v.T).argmax(axis=1)
    return pc.if_else(pa.array(missing), pa.array(values, col.type).take(pa.array(code)), col), pa.array(missing)


def held_out_errors(df: DataFrame, entity: str, period: str, fields: Mapping[str, tuple[float, float]], context: Mapping[str, tuple[float, float]] | None = None, categorical: Sequence[str] = (), rank: int = 4, rounds: int = 6, reg: float = 0.3, seed: int = 7) -> DataFrame:
    """(field_name, n, als, last, mid, belief): median absolute errors on the held-out known cells that have an earlier value: of this
    method, of carrying the last value forward and of the median of the entity's other values."""
    cells, model = _cells(df, entity, period, fields, dict(context or {}), list(categorical), rank, rounds, reg, seed)
    names = list(fields)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m, g, _ = model.guess(b, hide=True)
            use = model.coding.held(b, len(names)) & (m[:, : len(names)] > 0)
            for j, f in enumerate(names):
                true, lag, mid = (model.coding.column(b, c) for c in (f, f"__lag_{f}", f"__mid_{f}"))
                at = np.flatnonzero(use[:, j] & np.isfinite(lag))
                if len(at):
                    off = [np.abs(true - y)[at] for y in (model.value(b, j, g), lag, mid)]
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(at)), *map(pa.array, off)], ["field_name", "als", "last", "mid"])

    got = cells.mapInArrow(errors, "field_name string, als double, last double, mid double")
    believed = F.create_map(*[x for f, b in zip(names, model.belief) for x in (F.lit(f), F.lit(float(b)))])
    return got.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(c) for c in ("als", "last", "mid")]).withColumn("belief", believed[F.col("field_name")])
