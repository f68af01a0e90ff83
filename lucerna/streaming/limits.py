"""Request limits: which requests pass a sliding window, over a table and over a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _pass(times: list[float], passed: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which times pass, given those that passed before; a refused request isn't counted, one exactly seconds old still is."""
    out = []
    for t in times:
        while passed and passed[0] < t - seconds:
            passed.pop(0)
        ok = len(passed) < limit
        if ok:
            passed.append(t)
        out.append(ok)
    return out, passed


def limited_requests(events: DataFrame, key: str, time: str, order: str, limit: int = 120, seconds: int = 60) -> DataFrame:
    """(order, key, allowed) of every request; rows with a null key or time are left out.

    Whether a request passes depends on those that passed before it, so each key's requests are taken in order of time and id.
    They stream through a task that holds the passed times of one window, at most limit of them, never a
    key's requests; the sort before it spills.
    """
    t = F.col(time).cast("timestamp").cast("double")
    e = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(order).alias("id"), F.col(key).alias("who"), t.alias("at"))
    kinds = dict(e.dtypes)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, passed = None, deque()
        for b in batches:
            ok = []
            for w, at in zip(b["who"].tolist(), b["at"].tolist(), strict=True):
                if w != who:
                    who, passed = w, deque()
                while passed and passed[0] < at - seconds:
                    passed.popleft()
                ok.append(len(passed) < limit)
                if ok[-1]:
                    passed.append(at)
            yield pd.DataFrame({"id": b["id"], "who": b["who"], "allowed": ok})

    sorted_ = e.repartition("who").sortWithinPartitions("who", "at", "id")
    out = sorted_.mapInPandas(stream, f"id {kinds['id']}, who {kinds['who']}, allowed boolean")
    return out.select(F.col("id").alias(order), F.col("who").alias(key), "allowed")


def limit_stream(stream: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """The same over a stream (who string, at timestamp, id bigint): the times that passed are each key's state.

    A key's state is dropped when the watermark, an hour behind the latest request, has left its window; requests
    later than that are dropped, too.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "id"])
        ok, passed = _pass([x.timestamp() for x in pdf["at"]], passed, limit, seconds)
        state.update((passed,))
        last = int(1000 * (passed[-1] + seconds)) if passed else 0
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"id": pdf["id"], "who": pdf["who"], "allowed": ok})

    return stream.withWatermark("at", "1 hour").groupBy("who").applyInPandasWithState(step, "id bigint, who string, allowed boolean", "passed array<double>", "append", GroupStateTimeout.EventTimeTimeout)
