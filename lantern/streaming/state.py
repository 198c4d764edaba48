"""Keyed state: health after each run, and a rate limit; as streams, and over a finished table with the same step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEALTH = "key long, ts timestamp, consecutive_failures int, is_healthy boolean"


def health_step(state: tuple[bool, int], ok: bool) -> tuple[tuple[bool, int], bool]:
    """state: whether the key is known, and failures in a row. A success resets; the first run of all that fails is
    unhealthy at once, later ones at the third failure in a row; in between the key keeps its health."""
    known, failures = state
    failures = 0 if ok else failures + 1
    return (True, failures), ok or (known and failures < 3)


def _health(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known, failures, healthy = state.get if state.exists else (False, 0, True)
    runs = pd.concat(list(batches)).sort_values("ts")  # the runs of one key in one micro-batch
    for ok in runs["ok"]:
        was = healthy
        (known, failures), fine = health_step((known, failures), bool(ok))
        healthy = True if ok else (was and fine)
    state.update((known, failures, healthy))
    _until(state, runs["ts"].iloc[-1].timestamp() + _SILENT_SECONDS)
    yield pd.DataFrame({"key": [key[0]], "ts": [runs["ts"].iloc[-1]], "consecutive_failures": [failures], "is_healthy": [healthy]})


def _until(state: GroupState, seconds: float) -> None:
    """Lets the state go at that event time, or with the next watermark where that is past."""
    state.setTimeoutTimestamp(max(int(seconds * 1000), state.getCurrentWatermarkMs() + 1))


#: Seconds after which a key that hasn't run is forgotten; its next run counts as its first.
_SILENT_SECONDS = 30 * 86_400


def health_stream(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """runs: key, ts, ok. A row for each key and micro-batch, with the state after it. What is kept is one row a key, until it
    has been silent for thirty days of event time; rows that are later than `late` are left out."""
    timed = runs.withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(_health, HEALTH, "known boolean, failures int, healthy boolean", "update", GroupStateTimeout.EventTimeTimeout)


def admitted(times: list[float], limit: int, seconds: float, start: float | None = None, used: int = 0) -> tuple[list[bool], float | None, int]:
    """Which requests of one client pass. A window begins with the first request after the one before has ended."""
    out = []
    for t in times:
        if start is None or t - start >= seconds:
            start, used = t, 0
        used += 1
        out.append(used <= limit)
    return out, start, used


def rate_limit_stream(requests: DataFrame, limit: int = 20, seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """requests: key, ts. Each with allowed; a client's window and its count are the state, which goes when the watermark has
    passed the window's end, as the next request begins a new one then. Requests that are later than `late` are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        some = pd.concat(list(batches)).sort_values("ts")
        times = some["ts"].astype("datetime64[us]").astype("int64").div(1e6).tolist()
        ok, start, used = admitted(times, limit, seconds, start, used)
        state.update((start, used))
        _until(state, start + seconds)
        yield pd.DataFrame({"key": key[0], "ts": some["ts"].to_numpy(), "allowed": ok})

    timed = requests.withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(run, "key long, ts timestamp, allowed boolean", "start double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit(requests: DataFrame, limit: int = 20, seconds: float = 60.0) -> DataFrame:
    """The same over a table, without a group in memory: a client's rows are read in the order of time, and only the window
    and its count are kept from batch to batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, used = None, None, 0
        for some in batches:
            ok = []
            for k, t in zip(some["key"], some["ts"].astype("datetime64[us]").astype("int64"), strict=True):
                if k != key:
                    key, start, used = k, None, 0
                passed, start, used = admitted([t / 1e6], limit, seconds, start, used)
                ok += passed
            yield some.assign(allowed=ok)

    return requests.select("key", "ts").repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, "key long, ts timestamp, allowed boolean")
