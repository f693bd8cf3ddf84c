"""Detectors and learners over keyed streams: the same state machine in batch replay and in Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.streaming.detectors import make_detector
from tracelens.streaming.online import make_learner

_DRIFT = "key string, idx long"


def _in_order(df: DataFrame, key: str, columns: dict, order: list[str]) -> DataFrame:
    """Rows of a key together, in order, streamed through tasks: no key's history is held at once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("string").alias("__key"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[c.alias(name) for name, c in columns.items()])
    return rows.repartition(n, "__key").sortWithinPartitions("__key", *[f"__o{i}" for i in range(len(order))]).select("__key", *columns)


def _per_key(start: Callable, step: Callable, end: Callable):
    """A function of Arrow batches: start() gives a key's state, step(key, state, batch) rows out of the next of its rows,
    end(key, state) its last rows. A null key is one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("__key")
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                here = (keys[lo].as_py(),)
                if state is None or here != key:
                    if state is not None:
                        yield end(key[0], state)
                    key, state = here, start()
                yield step(key[0], state, b.slice(lo, hi - lo))
        if state is not None:
            yield end(key[0], state)

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles of a column, null as NaN."""
    return column.to_numpy(zero_copy_only=False).astype(float)


def _drifts(key: str | None, found: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series([key] * len(found), dtype="object"), "idx": pd.Series(found, dtype="int64")})


def _found(key: str | None, found: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array([key] * len(found), pa.string()), "idx": pa.array(found, pa.int64())})


def replay_detector(df: DataFrame, key: str, order: str | list[str], value: str, detector: str, **kw) -> DataFrame:
    """Drifts of each key's values in order (rows of one key are one sequence; ties by the further columns of order, then
    by value): key, idx (from 0)."""
    make_detector(detector, **kw)  # raises here if it can't

    def step(key, d, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = len(d.drift_indices)
        d.update_many(_numbers(rows.column("__v")))
        return _found(key, d.drift_indices[n:])

    order = [order] if isinstance(order, str) else order
    rows = _in_order(df, key, {"__v": F.col(value).cast("double")}, [*order, value])
    return rows.mapInArrow(_per_key(lambda: make_detector(detector, **kw), step, lambda key, d: _found(key, [])), _DRIFT)


def stream_detector(df: DataFrame, key: str, order: str, value: str, detector: str, **kw) -> DataFrame:
    """The same over a streaming frame; the detector is the key's state, so a restarted query goes on exactly.

    Rows of a micro-batch are put in order. A row that comes late, with an order below one already seen of its key, is
    left out: the detector has moved on."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        d, last = pickle.loads(state.get[0]) if state.exists else (make_detector(detector, **kw), None)
        found = []
        # a micro-batch may bring a key in several frames
        rows = pd.concat(list(frames)).sort_values(["o", "v"], kind="stable")
        if last is not None:
            rows = rows[rows["o"] >= last]
        for x in rows["v"]:
            if d.update(x):
                found.append(d.drift_indices[-1])
        if len(rows):
            last = rows["o"].iloc[-1]
        state.update((pickle.dumps((d, last)),))
        yield _drifts(k[0], found)

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("k").applyInPandasWithState(run, _DRIFT, "state binary", "append", "NoTimeout")


def tumbling_counts(df: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """Counts by window and type of a streaming frame with a watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"))


def prequential(df: DataFrame, key: str, period: str, order: str | list[str], features: list[str], label: str, learner: str, detector: str | None = None, **kw) -> DataFrame:
    """Each key's rows by period and order: score first, then the detector sees the loss, then the learner learns. A row
    per period with the confusion at 0.5 and the drifts found."""
    make_learner(learner, len(features), **kw)

    def start() -> dict:
        return {"model": make_learner(learner, len(features), **kw), "detector": make_detector(detector) if detector else None, "period": None, "n": [0, 0, 0, 0, 0]}

    def row(key, s: dict) -> tuple:
        return (key, s["period"], *s["n"])

    names = ["key", "period", "tn", "fp", "fn", "tp", "drifts"]
    kinds = [pa.string()] * 2 + [pa.int64()] * 5

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def step(key, s: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        learn, watch, n = s["model"].score_and_learn, s["detector"].update if s["detector"] is not None else None, s["n"]
        xs = zip(*[_numbers(rows.column(f"__x{i}")).tolist() for i in range(len(features))], strict=True)
        for p, x, y in zip(rows.column("__p").to_pylist(), xs, rows.column("__y").to_pylist(), strict=True):
            if p != s["period"]:
                if s["period"] is not None:
                    out.append(row(key, s))
                n = [0, 0, 0, 0, 0]
                s["period"], s["n"] = p, n
            y = int(y)
            hit = 1 if learn(x, y) >= 0.5 else 0
            n[2 * y + hit] += 1
            if watch is not None:
                n[4] += watch(float(hit != y))
        return table(out)

    order = [order] if isinstance(order, str) else order
    columns = {"__p": F.col(period).cast("string"), "__y": F.col(label).cast("int"), **{f"__x{i}": F.col(c).cast("double") for i, c in enumerate(features)}}
    rows = _in_order(df, key, columns, [period, *order])
    run = _per_key(start, step, lambda key, s: table([row(key, s)]))
    return rows.mapInArrow(run, "key string, period string, tn long, fp long, fn long, tp long, drifts long")


def covariate_scan(df: DataFrame, feature_columns: list[str], time: str, reference_until, detector: str = "ks", key: str | None = None, onset=None, **kw) -> DataFrame:
    """Per feature: the first time its values drift from those up to reference_until, how many drifts there are, and the
    days from an onset to the first one. The features are streams of their own, spread over tasks."""
    kind = df.schema[time].dataType
    long = df.select(F.col(time).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in feature_columns])).alias("x"), *([F.col(key).alias("id")] if key else [F.lit(0).alias("id")]))
    rows = _in_order(long.select("t", "x.*", "id"), "feature", {"__t": F.col("t"), "__v": F.col("v"), "__ref": F.col("t") <= F.lit(reference_until)}, ["t", "id", "v"])

    def start() -> dict:
        return {"ref": [], "held": 0, "d": None, "first": None, "n": 0}

    def distinct(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def step(key, s: dict, part: pa.RecordBatch) -> pa.RecordBatch:
        v, ref = _numbers(part.column("__v")), part.column("__ref").fill_null(False).to_numpy(zero_copy_only=False)
        late = np.flatnonzero(~ref)
        if s["d"] is None:
            # the reference is held as its distinct values and their counts
            known = v[: late[0]] if len(late) else v
            known = known[~np.isnan(known)]
            s["ref"].append(np.unique(known, return_counts=True))
            s["held"] += len(s["ref"][-1][0])
            if s["held"] > 500_000 and len(s["ref"]) > 50:
                s["ref"] = [distinct(s["ref"])]
                s["held"] = 0
        if len(late):
            if s["d"] is None:
                s["d"] = make_detector(detector, **kw)
                values, counts = distinct(s["ref"])
                if counts.sum() >= 2:
                    s["d"].set_reference(values, counts)
                s["ref"] = []
            hits = s["d"].update_many(v[late])
            s["n"] += len(hits)
            if hits and s["first"] is None:
                s["first"] = part.column("__t")[int(late[hits[0]])].as_py()
        s["kind"] = part.column("__t").type
        return table([], [], [], s)

    def table(feature: list, n: list, first: list, s: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"feature": pa.array(feature, pa.string()), "n_drifts": pa.array(n, pa.int64()), "first_drift": pa.array(first, s["kind"])})

    def end(key, s: dict) -> pa.RecordBatch:
        return table([key], [s["n"]], [s["first"]], s)

    out = rows.mapInArrow(_per_key(start, step, end), f"feature string, n_drifts long, first_drift {kind.simpleString()}")
    return out.withColumn("latency_days", F.datediff("first_drift", F.lit(onset)) if onset is not None else F.lit(None).cast("int"))


def events_by_month(events: DataFrame, detector: str, time: str) -> DataFrame:
    """Drift events by detector and month."""
    return events.groupBy(detector, F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def availability(df: DataFrame, time: str, columns: list[str], least: float = 0.5) -> DataFrame:
    """Per column: the first month in which less than `least` of the rows have a value, and that month's share; nulls
    where there is none."""
    m = F.date_format(time, "yyyy-MM").alias("month")
    shares = df.groupBy(m).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    long = shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), "month", F.col(c).alias("share")) for c in columns])).alias("x")).select("x.*")
    low = F.when(F.col("share") < least, F.struct("month", "share"))
    return long.groupBy("column").agg(F.min(low).alias("first")).select("column", F.col("first.month").alias("month"), F.col("first.share").alias("share"))
