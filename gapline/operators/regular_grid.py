"""Irregular readings onto a regular grid by a Kalman smoother with a local linear trend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.staging import join_bounded

#: Candidate ratios of trend noise (per cadence cubed) to reading noise; each series takes the likeliest.
RATIOS = (1e-5, 1e-3, 1e-1, 10.0)
#: Series smoothed side by side.
BLOCK = 256


def smooth(y: np.ndarray, n: np.ndarray, shift: np.ndarray, ratios: tuple[float, ...] = RATIOS) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed values and standard deviations of many series side by side.

    ``y``, ``n``, ``shift``: arrays (series, steps): the mean of the readings of a
    step, their number (0 where there is none) and their mean time from the
    middle of the step, in steps. The state is a level and a slope in continuous
    time; a reading off the middle sees level + shift * slope. Reading noise is
    estimated from the innovations, for each ratio, and the likeliest ratio kept.
    Series without a reading give NaN.
    """
    count, steps = y.shape
    seen = n > 0
    used = np.maximum(seen.sum(1), 1)
    centre = np.where(seen, y, 0).sum(1) / used
    y = np.where(seen, y - centre[:, None], 0.0)
    spread = np.sqrt(np.where(seen, y**2, 0).sum(1) / used)
    scale = np.where(spread > 0, spread, 1.0)
    y = y / scale[:, None]

    def filtered(q: np.ndarray, keep: bool):
        q00, q01, q11 = q / 3, q / 2, q
        a, b = np.zeros(count), np.zeros(count)
        p00, p01, p11 = np.full(count, 1e4), np.zeros(count), np.full(count, 1e2)
        logdet, squares = np.zeros(count), np.zeros(count)
        store = np.empty((10, steps, count)) if keep else None
        for k in range(steps):
            if k:  # one step on
                a = a + b
                p00 = p00 + 2 * p01 + p11 + q00
                p01 = p01 + p11 + q01
                p11 = p11 + q11
            if keep:
                store[0, k], store[1, k], store[2, k], store[3, k], store[4, k] = a, b, p00, p01, p11
            h, m = shift[:, k], seen[:, k]
            if m.any():
                g0, g1 = p00 + h * p01, p01 + h * p11
                f = g0 + h * g1 + 1.0 / np.maximum(n[:, k], 1)
                e = np.where(m, y[:, k] - a - h * b, 0.0)
                w = np.where(m, 1.0 / f, 0.0)
                logdet += np.where(m, np.log(f), 0.0)
                squares += e * e * w
                k0, k1 = g0 * w, g1 * w
                a, b = a + k0 * e, b + k1 * e
                p00, p01, p11 = p00 - k0 * g0, p01 - k0 * g1, p11 - k1 * g1
            if keep:
                store[5, k], store[6, k], store[7, k], store[8, k], store[9, k] = a, b, p00, p01, p11
        return logdet, squares, store

    best, chosen = np.full(count, np.inf), np.full(count, ratios[0])
    for r in ratios:
        logdet, squares, _ = filtered(np.full(count, r), False)
        cost = logdet + used * np.log(np.maximum(squares / used, 1e-12))
        better = cost < best
        best, chosen = np.where(better, cost, best), np.where(better, r, chosen)
    _, squares, s = filtered(chosen, True)
    noise = np.maximum(squares / used, 1e-12)

    level, var = np.empty((steps, count)), np.empty((steps, count))
    a, b, p00, p01, p11 = s[5:10, -1]
    level[-1], var[-1] = a, p00
    for k in range(steps - 2, -1, -1):
        fa, fb, f00, f01, f11 = s[5:10, k]
        na, nb, n00, n01, n11 = s[0:5, k + 1]
        # Gain: filtered covariance times transposed transition times inverse of the predicted covariance.
        c00, c01, c10, c11 = f00 + f01, f01, f01 + f11, f11
        det = np.maximum(n00 * n11 - n01 * n01, 1e-300)
        j00, j01 = (c00 * n11 - c01 * n01) / det, (c01 * n00 - c00 * n01) / det
        j10, j11 = (c10 * n11 - c11 * n01) / det, (c11 * n00 - c10 * n01) / det
        da, db = a - na, b - nb
        d00, d01, d11 = p00 - n00, p01 - n01, p11 - n11
        a, b = fa + j00 * da + j01 * db, fb + j10 * da + j11 * db
        u0, u1, w0, w1 = j00 * d00 + j01 * d01, j00 * d01 + j01 * d11, j10 * d00 + j11 * d01, j10 * d01 + j11 * d11
        p00, p01, p11 = f00 + u0 * j00 + u1 * j01, f01 + u0 * j10 + u1 * j11, f11 + w0 * j10 + w1 * j11
        level[k], var[k] = a, p00
    none = ~seen.any(1)
    value = level.T * scale[:, None] + centre[:, None]
    sd = np.sqrt(np.maximum(var.T, 0) * noise[:, None]) * scale[:, None]
    value[none], sd[none] = np.nan, np.nan
    return value, sd


GRID = "view_id bigint, epoch_index int, n_readings bigint, observed double, filled double, uncertainty double, is_empty boolean"
SCHEMA = pa.schema([("view_id", pa.int64()), ("epoch_index", pa.int32()), ("n_readings", pa.int64()), ("observed", pa.float64()), ("filled", pa.float64()), ("uncertainty", pa.float64()), ("is_empty", pa.bool_())])


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("view_id").to_numpy(zero_copy_only=False)
        epochs = batch.column("epochs").to_numpy(zero_copy_only=False).astype(int)
        logs = batch.column("log_scale").to_numpy(zero_copy_only=False).astype(bool)
        lists = batch.column("cells")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
        at, n_all, n_used, mean, shift = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        order = np.argsort(epochs, kind="stable")
        for lo in range(0, len(order), BLOCK):
            rows = order[lo : lo + BLOCK]
            steps = int(epochs[rows].max(initial=0))
            if not steps:
                continue
            shape = (len(rows), steps)
            y, used, total, off = np.zeros(shape), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape)
            for i, r in enumerate(rows):
                part = slice(ends[r], ends[r + 1])
                e = at[part]
                total[i, e] = n_all[part]
                used[i, e] = n_used[part]
                y[i, e] = mean[part]
                off[i, e] = shift[part]
            y = np.where(used > 0, y, 0.0)
            off = np.where(used > 0, off, 0.0)
            log = logs[rows][:, None]
            worked = np.where(log, np.sign(y) * np.log1p(np.abs(y)), y)
            value, sd = smooth(worked, used, off)
            with np.errstate(over="ignore"):
                value = np.where(log, np.sign(value) * np.expm1(np.minimum(np.abs(value), 700)), value)
                sd = np.where(log, sd * (1 + np.abs(value)), sd)
            inside = np.arange(steps)[None, :] < epochs[rows][:, None]
            pick = lambda x: x[inside]  # noqa: E731, B023
            seen = np.where(used > 0, y, np.nan)
            out = [
                np.repeat(ids[rows], epochs[rows]),
                pick(np.broadcast_to(np.arange(steps, dtype=np.int32), shape)),
                pick(total),
                pa.array(pick(seen), from_pandas=True),
                pa.array(pick(value), from_pandas=True),
                pa.array(pick(sd), from_pandas=True),
                pick(total) == 0,
            ]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], schema=SCHEMA)


def regular_grid(records: DataFrame, views: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row for each epoch of each view, with the smoothed value at the epoch's middle.

    An epoch is a half-open stretch of the primitive's cadence; it is empty if no
    record of the view with a value that is neither null nor NaN takes effect in
    it. Infinite values fill an epoch but aren't smoothed. Readings are reduced to
    number, mean and mean time for (view, epoch) before they meet, so a view
    costs at most its expected epochs, however many records it has. Light, usage
    and steps (by the primitive's value column) are smoothed as signed log(1 + x);
    the uncertainty is brought back to their unit by the slope there, 1 + |filled|.

    Result: ``view_id``, ``epoch_index``, ``n_readings``, ``observed`` (mean of the
    finite readings, null if none), ``filled`` (smoothed value, null in a view
    without a finite reading), ``uncertainty`` (standard deviation) and
    ``is_empty``. Views without records have only empty epochs. Repeated rows of
    either table count once. Views with a null id, window or unknown primitive
    give nothing; records outside of their view's window, of no view, or without
    an effective time are ignored. Tables may be empty and have other columns.
    """
    defs = definitions.select("primitive", F.col("cadence_minutes").cast("bigint").alias("cadence"), F.col("expected_epochs").cast("int").alias("epochs"), F.coalesce(F.col("value_column").rlike("light|step|usage"), F.lit(False)).alias("log_scale")).where("cadence > 0 and epochs > 0").dropDuplicates(["primitive"])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    frames = join_bounded(views.select("view_id", "primitive", us("window_start").alias("start")).where("view_id is not null and start is not null").distinct(), defs, ["primitive"])
    frames = frames.groupBy("view_id").agg(F.min(F.struct("start", "cadence", "epochs", "log_scale")).alias("f")).select("view_id", "f.*")
    read = (
        records.select("view_id", "record_id", us("effective_timestamp").alias("t"), F.col("raw_value").alias("v"))
        .where("v is not null and not isnan(v) and t is not null and view_id is not null")
        .distinct()
    )
    step = F.col("cadence") * 60_000_000
    placed = (
        join_bounded(read, frames.select("view_id", "start", "cadence", "epochs"), ["view_id"])
        .withColumn("epoch", F.floor((F.col("t") - F.col("start")) / step).cast("int"))
        .where("epoch >= 0 and epoch < epochs")
    )
    finite = F.abs("v") < F.lit(float("inf"))
    middle = F.col("start") + (F.col("epoch") + 0.5) * step
    cells = placed.groupBy("view_id", "epoch").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(finite, 1)).alias("used"),
        F.avg(F.when(finite, F.col("v"))).alias("mean"),
        F.avg(F.when(finite, (F.col("t") - middle) / step)).alias("shift"),
    )
    lists = cells.groupBy("view_id").agg(F.collect_list(F.struct("epoch", "n", "used", "mean", "shift")).alias("cells"))
    series = frames.select("view_id", "epochs", "log_scale").join(lists, "view_id", "left")
    empty = F.array().cast("array<struct<epoch:int,n:bigint,used:bigint,mean:double,shift:double>>")
    return series.withColumn("cells", F.coalesce("cells", empty)).mapInArrow(_grids, GRID)
