"""A time-limited cache of loaded histories."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

# Fixed lifetimes in seconds: 12 hours for US histories, 15 minutes for Korean ones.
LIFETIME = {"US": 12 * 3600, "KR": 15 * 60}


class HistoryCache:
    """Persisted frames by (market, symbol, size); one that is too old is dropped and loaded again."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.lock, self.held = clock, threading.Lock(), {}

    def get(self, market: str, symbol: str, size: str, load: Callable[[], DataFrame]) -> DataFrame:
        key, now = (market, symbol, size), self.clock()
        with self.lock:
            frame, loaded = self.held.get(key, (None, 0.0))
            if frame is not None and now - loaded < LIFETIME[market]:
                return frame
            if frame is not None:
                frame.unpersist()
            frame = load().persist()
            self.held[key] = frame, now
            return frame

    def clear(self) -> None:
        with self.lock:
            for frame, _ in self.held.values():
                frame.unpersist()
            self.held.clear()
