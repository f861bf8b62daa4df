"""Indicators that feed on their own last value: exponential averages, RSI, MACD, ATR, ADX.

Windows cannot refer to their own output, so one pass in Arrow batches does it. Bars are dealt by symbol and sorted;
a symbol's state is carried from batch to batch, so memory doesn't grow with its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.schema import MA_PERIODS

from .exprs import before, pdiv
from .indicators import average_ratios

COLUMNS = [*(f"ema_{n}" for n in MA_PERIODS), "rsi_14", "rsi_21", "macd", "macd_signal", "atr_14", "atr_21", "adx"]


class Smoother:
    """v += alpha * (x - v), from the mean of the first `seed` values; missing values leave it as it was."""

    def __init__(self, alpha: float, seed: int = 1):
        self.alpha, self.seed, self.taken, self.total, self.value, self.seen = alpha, seed, 0, 0.0, None, 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, at = np.full(len(x), np.nan), 0
        while self.value is None and at < len(x):
            if not np.isnan(x[at]):
                self.taken, self.total = self.taken + 1, self.total + x[at]
                if self.taken == self.seed:
                    self.value = float(self.total / self.seed)
                    out[at] = self.value
            at += 1
        if at < len(x):
            rest = pd.Series(np.concatenate(([self.value], x[at:])))
            out[at:] = rest.ewm(alpha=self.alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
            self.value = float(out[-1])
        return out

    def summary(self, x: np.ndarray) -> list[float]:
        """What a slice does to a smoother, whatever its state: number of values, what they make of 0, and the first `seed` of them."""
        known = x[~np.isnan(x)]
        return [float(len(known)), self._from_zero(known), *np.pad(known[: self.seed], (0, max(0, self.seed - len(known))), constant_values=np.nan).tolist()]

    def _from_zero(self, values: np.ndarray) -> float:
        return float(pd.Series(np.concatenate(([0.0], values))).ewm(alpha=self.alpha, adjust=False).mean().iloc[-1]) if len(values) else 0.0

    def advance(self, summary: list[float]) -> None:
        """Be as after a slice: its values complete the seed if that is open, the others are one affine map."""
        count, made = int(summary[0]), summary[1]
        head = min(self.seed - self.taken, count) if self.value is None else 0
        first = np.array(summary[2 : 2 + head])
        self.taken, self.total, self.seen = self.taken + head, self.total + float(first.sum()), self.seen + count
        if self.value is None and self.taken == self.seed:
            self.value = float(self.total / self.seed)
        if self.value is not None:
            keep = (1 - self.alpha) ** (count - head)
            self.value = keep * self.value + made - keep * self._from_zero(first)

    def state(self) -> list[float]:
        return [float(self.taken), self.total, np.nan if self.value is None else self.value, float(self.seen)]

    def restore(self, state: list[float]) -> None:
        self.taken, self.total, self.value, self.seen = int(state[0]), float(state[1]), None if np.isnan(state[2]) else float(state[2]), int(state[3])


class Counted(Smoother):
    """As above from the first value on, but hidden until `least` values have come."""

    def __init__(self, alpha: float, least: int):
        super().__init__(alpha)
        self.least = least

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = super().__call__(x)
        seen = self.seen + np.cumsum(~np.isnan(x))
        self.seen = int(seen[-1]) if len(seen) else self.seen
        return np.where((seen >= self.least) & ~np.isnan(x), out, np.nan)


class SymbolState:
    """All smoothers of a symbol, and its last bar. Those of `first` take series of the bars, those of `second` series that the first make."""

    def __init__(self) -> None:
        self.first: dict[str, Smoother] = {f"ema_{n}": Counted(2 / (n + 1), n) for n in MA_PERIODS}
        self.first |= {"fast": Counted(2 / 13, 12), "slow": Counted(2 / 27, 26)}
        self.first |= {f"{side}_{n}": Counted(1 / n, n) for side in ("up", "down") for n in (14, 21)}
        self.first |= {f"atr_{n}": Smoother(1 / n, n) for n in (14, 21)} | {k: Smoother(1 / 14, 14) for k in ("span", "plus", "minus")}
        self.second: dict[str, Smoother] = {"signal": Counted(2 / 10, 9), "trend": Smoother(1 / 14, 14)}
        self.last = (np.nan, np.nan, np.nan)
        self.begun = False

    def inputs(self, p: np.ndarray, high: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
        """What the first smoothers take from bars that follow the last one."""
        last_p, last_high, last_low = (np.concatenate(([v], x[:-1])) for v, x in zip(self.last, (p, high, low), strict=True))
        moved = p - last_p
        if not self.begun:
            moved[0] = 0.0
        gain, fall_ = (np.where(np.isnan(moved), np.nan, np.maximum(m, 0)) for m in (moved, -moved))
        true_range = np.fmax(high - low, np.fmax(np.abs(high - last_p), np.abs(low - last_p)))
        rise, fall = high - last_high, last_low - low
        known = ~np.isnan(rise)
        out = dict.fromkeys((*(f"ema_{n}" for n in MA_PERIODS), "fast", "slow"), p) | {f"up_{n}": gain for n in (14, 21)} | {f"down_{n}": fall_ for n in (14, 21)} | {f"atr_{n}": true_range for n in (14, 21)}
        return out | {"span": np.where(known, true_range, np.nan), "plus": np.where(known, np.where((rise > fall) & (rise > 0), rise, 0.0), np.nan), "minus": np.where(known, np.where((fall > rise) & (fall > 0), fall, 0.0), np.nan)}

    def made(self, p: np.ndarray, high: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
        """What the first smoothers make of some bars, among it the inputs of the second: macd and strength."""
        got = {k: self.first[k](x) for k, x in self.inputs(p, high, low).items()}
        self.last, self.begun = (p[-1], high[-1], low[-1]), True
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = got["plus"] / got["span"], got["minus"] / got["span"]
            got["strength"] = np.where(np.isnan(got["span"]), np.nan, np.nan_to_num(100 * np.abs(a - b) / (a + b), nan=0.0, posinf=0.0))
        return got | {"macd": got["fast"] - got["slow"]}

    def step(self, p: np.ndarray, high: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
        got = self.made(p, high, low)
        out = {f"ema_{n}": got[f"ema_{n}"] for n in MA_PERIODS}
        for n in (14, 21):
            up, down = got[f"up_{n}"], got[f"down_{n}"]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"rsi_{n}"] = np.where(np.isnan(down), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))
            out[f"atr_{n}"] = np.nan_to_num(got[f"atr_{n}"], nan=0.0)
        return out | {"macd": got["macd"], "macd_signal": self.second["signal"](got["macd"]), "adx": self.second["trend"](got["strength"])}

    def state(self) -> list[float]:
        """Everything as numbers; `restore` is its inverse."""
        return [float(self.begun), *map(float, self.last), *(v for s in (*self.first.values(), *self.second.values()) for v in s.state())]

    def restore(self, state: list[float]) -> SymbolState:
        self.begun, self.last = bool(state[0]), tuple(state[1:4])
        for k, s in enumerate((*self.first.values(), *self.second.values())):
            s.restore(state[4 + 4 * k : 8 + 4 * k])
        return self


def recursive(df: DataFrame) -> DataFrame:
    """Adds the recursive indicators to bars with a price `p`, in one pass."""
    columns = [c for c in df.columns if c not in COLUMNS]
    df = df.select(*columns)
    shape = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, SymbolState()
        for frame in frames:
            if not len(frame):
                continue
            cut = np.flatnonzero(frame.symbol.to_numpy()[1:] != frame.symbol.to_numpy()[:-1]) + 1
            parts = []
            for a, b in zip([0, *cut], [*cut, len(frame)], strict=True):
                part = frame.iloc[a:b]
                if part.symbol.iloc[0] != symbol or symbol is None:
                    symbol, state = part.symbol.iloc[0], SymbolState()
                parts.append(state.step(*(part[c].to_numpy(float) for c in ("p", "high", "low"))))
            yield frame.assign(**{c: np.concatenate([x[c] for x in parts]) for c in COLUMNS})

    out = df.repartition("symbol").sortWithinPartitions("symbol", "bar_ts").mapInPandas(run, shape)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in COLUMNS})


def dependants(df: DataFrame) -> DataFrame:
    """What follows from the recursive columns: histogram, crossover, changes, ratios and slopes."""
    df = average_ratios(df, "ema")
    return df.withColumns({
        "macd_histogram": F.col("macd") - F.col("macd_signal"), "macd_crossover": F.coalesce((F.col("macd") > F.col("macd_signal")).cast("int"), F.lit(0)),
        "rsi_14_change": F.col("rsi_14") - before(F.col("rsi_14"), 1), "rsi_21_change": F.col("rsi_21") - before(F.col("rsi_21"), 1),
        "volatility_ratio": pdiv(F.col("atr_14"), F.col("atr_21")),
    })
