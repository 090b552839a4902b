"""Trajectories kept by cell in typed state with timers, and pairs of two streams within a time of each other.

A cell's observations wait until the watermark has passed them and are then taken in order of (ts, seq), so how they were dealt
to batches, and in which order they came, changes nothing: the result is that of `temporal.baseline` over all rows that the
watermark has passed. Rows later than the watermark are dropped, rows without ts are left out. A null cell is a cell like
others; a null value or share seen is no observation.

State of a cell: its fit and its CUSUM, which do not grow, and the rows that wait, no more than come within the watermark's
delay. With `forget`, a cell that is silent for so long is cleared, and starts anew if it comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoloom.operators import temporal

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODEL = "fit array<double>, cov array<double>, error array<double>, n long, cusum double, over long, broken boolean, calm date, rise date"
OUT = "seq long, ts timestamp, obs_state string, z double, cusum double, lower date, upper date, interval_days int"


def _packed(cell: temporal.Online) -> tuple:
    flat = lambda x: [float(v) for v in x.ravel()]
    return flat(cell.fit.fit), flat(cell.fit.cov), flat(cell.fit.error), int(cell.n), float(cell.cusum), int(cell.over), bool(cell.broken), cell.calm, cell.rise


def _unpacked(kept: tuple | None, dims: int) -> temporal.Online:
    cell = temporal.Online(dims)
    if kept is not None:
        fit, cov, error, cell.n, cell.cusum, cell.over, cell.broken, cell.calm, cell.rise = kept
        cell.fit.fit, cell.fit.cov, cell.fit.error = np.reshape(fit, (1, dims, 6)), np.reshape(cov, (1, 6, 6)), np.reshape(error, (1, dims))
    return cell


def _millis(ts) -> int:
    """Of a time in UTC without its zone, rounded down."""
    return (ts - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


class Tracks(StatefulProcessor):
    def __init__(self, key: str, dims: int, forget: timedelta | None):
        self.key, self.dims, self.forget = key, dims, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", MODEL)
        self.waiting = handle.getListState("waiting", "us long, seq long, values array<double>, share double")
        self.due = handle.getValueState("due", "ms long")

    def _set_timer(self, at: int) -> None:
        """One timer for a cell: the earlier one of what is set and `at`."""
        if self.due.exists():
            (was,) = self.due.get()
            if was <= at:
                return
            self.handle.deleteTimer(was)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            us = f.ts.to_numpy().astype("datetime64[us]").astype("int64")
            values = [None if v is None or np.isnan(np.asarray(v, float)).any() else [float(x) for x in v] for v in f["values"]]
            share = [0.0 if pd.isna(s) else float(s) for s in f.valid_fraction]
            self.waiting.appendList([(int(t), int(q), v, s) for t, q, v, s in zip(us, f.seq, values, share, strict=True)])
            self._set_timer(int(us.min()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = sorted((r for r in rows if r[0] <= limit), key=lambda r: r[:2]), [r for r in rows if r[0] > limit]
        self.due.clear()
        if not rows:  # silent for as long as forget
            self.model.clear()
            return
        if rest:
            self.waiting.put(rest)
            self._set_timer(min(r[0] for r in rest) // 1000)
        else:
            self.waiting.clear()
            if self.forget:
                self._set_timer(limit // 1000 + self.forget // timedelta(milliseconds=1))
        cell, out = _unpacked(self.model.get() if self.model.exists() else None, self.dims), []
        for us, seq, values, share in ready:
            at = datetime(1970, 1, 1) + timedelta(microseconds=us)
            told = cell.observe(at.date(), values, share if values is not None else 0.0)
            out.append((key[0], seq, at, *(told[c] for c in ("obs_state", "z", "cusum", "lower", "upper", "interval_days"))))
        self.model.update(_packed(cell))
        if out:
            names = [self.key, *(c.split()[0] for c in OUT.split(", "))]
            frame = pd.DataFrame(out, columns=names).astype({"ts": "datetime64[ns]", "interval_days": "Int32"})
            frame["ts"] = frame.ts.dt.tz_localize(UTC)
            yield frame

    def close(self) -> None:
        pass


def trajectories(stream: DataFrame, dims: int, late: str = "1 day", key: str = "cell_id", forget: timedelta | None = None) -> DataFrame:
    """stream (key, seq, ts, values array<double>, valid_fraction) -> key, seq, ts, obs_state, z, cusum, and at a cell's first
    break lower, upper and interval_days, once the watermark has passed the observation."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what typed state needs
    rows = stream.select(key, F.col("seq").cast("long").alias("seq"), "ts", "values", F.col("valid_fraction").cast("double").alias("valid_fraction"))
    kind = dict(stream.dtypes)[key]
    grouped = rows.where(F.col("ts").isNotNull()).withWatermark("ts", late).groupBy(key)
    return grouped.transformWithStateInPandas(Tracks(key, dims, forget), f"{key} {kind}, {OUT}", "Append", "EventTime")


def paired(left: DataFrame, right: DataFrame, keys: list[str], within: str, late: str = "1 day") -> DataFrame:
    """Rows of two streams (keys, ts, ..) with equal keys whose times are at most `within` apart, as columns of l and r. Each
    side is kept only while a row of the other may still come: the watermark's delay and `within`."""
    l, r = left.withWatermark("ts", late).alias("l"), right.withWatermark("ts", late).alias("r")  # noqa: E741
    near = F.expr(f"r.ts >= l.ts - INTERVAL {within} AND r.ts <= l.ts + INTERVAL {within}")
    for k in keys:
        near = near & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, near)
