"""Replay of a sliding-window rate limiter over a table of requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed limits: operation -> (per address, per user, window in seconds).
LIMITS = {"analyze": (30, 15, 60), "monitor": (10, 5, 60), "train": (5, 3, 3600), "backtest": (12, 8, 60)}


def replay_limit(requests: DataFrame, key: str, limit: int, window_seconds: int) -> DataFrame:
    """accepted and retry_after for every request (key, ts, request_id) of one kind of bucket.

    A request is accepted if fewer than `limit` accepted ones of its key are younger than the window; ties in time go
    by request_id. Requests are dealt by key and sorted; a key's state is its last `limit` accepted times at most.
    """
    span = window_seconds * 1_000_000
    shape = f"{key} {dict(requests.dtypes)[key]}, request_id long, ts timestamp_ntz, accepted boolean, retry_after double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken = None, deque()
        for frame in frames:
            if not len(frame):
                continue
            names, at = frame[key].to_numpy(), frame.ts.to_numpy("datetime64[us]").astype(np.int64)
            accepted, wait = np.zeros(len(frame), bool), np.full(len(frame), np.nan)
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(frame)], strict=True):
                if current is None or names[a] != current:
                    current, taken = names[a], deque(maxlen=limit)
                while a < b:  # from one accepted request to the next
                    if len(taken) == limit and limit:
                        to = a + int(np.searchsorted(at[a:b], taken[0] + span))
                        wait[a:to] = np.maximum(1.0, window_seconds - (at[a:to] - taken[0]) / 1e6)
                        a = to
                    elif not limit:
                        a = b
                    if a < b:
                        accepted[a] = True
                        taken.append(at[a])
                        a += 1
            yield pd.DataFrame({key: frame[key], "request_id": frame.request_id, "ts": frame.ts, "accepted": accepted, "retry_after": wait})

    rows = requests.select(key, "request_id", "ts").where(f"{key} is not null and ts is not null")
    return rows.repartition(key).sortWithinPartitions(key, "ts", "request_id").mapInPandas(run, shape)


def replay(requests: DataFrame, address: str, user: str, address_limit: int, user_limit: int, window_seconds: int = 60) -> DataFrame:
    """Both buckets in turn: a request that its address's bucket accepts is recorded there even if its user's rejects it."""
    first = replay_limit(requests, address, address_limit, window_seconds)
    passed = requests.join(first.where("accepted").select("request_id"), "request_id")
    second = replay_limit(passed, user, user_limit, window_seconds).select("request_id", "accepted")
    return first.select("request_id", first.accepted.alias("address_ok")).join(second.withColumnRenamed("accepted", "user_ok"), "request_id", "left")
