"""The questions a user asks, validated and rate-limited: train, analyze, screen, monitor, backtest."""

from __future__ import annotations

import time
from collections import defaultdict, deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.recursive import recursive
from barwright.functions.indicators import with_price
from barwright.operators import backtest, bars, model, signals
from barwright.operators.ratelimit import LIMITS
from barwright.operators.validate import InvalidRequest, choice, distinct_symbols, number, only_fields
from barwright.schema import LOOKFORWARD, MIN_BARS, MIN_MODEL_BARS, MODEL_THRESHOLD, SWING_THRESHOLD

MARKETS = ("US", "KR")


class TooManyRequests(RuntimeError):
    def __init__(self, message: str, retry_after: float):
        super().__init__(message)
        self.reply = {"status": 429, "error": "rate_limited", "message": message, "retry_after_seconds": retry_after}


class RateLimiter:
    """Sliding windows by operation and address, then by operation and user; each records what it accepts."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.taken = clock, defaultdict(deque)

    def enforce(self, operation: str, address: str, user: str) -> None:
        address_limit, user_limit, window = LIMITS[operation]
        for kind, who, limit in (("address", address, address_limit), ("user", user, user_limit)):
            now, taken = self.clock(), self.taken[operation, kind, who]
            while taken and now - taken[0] >= window:
                taken.popleft()
            if len(taken) >= limit:
                raise TooManyRequests(f"too many {operation} requests for this {kind}", max(1, int(window - (now - taken[0]))))
            taken.append(now)


class Service:
    """One plan per question over all symbols asked for. `history` gives bars of a market; a trained model is optional."""

    def __init__(self, spark: SparkSession, history: Callable[[str], DataFrame], trained: model.Ensemble | None = None, limiter: RateLimiter | None = None):
        self.spark, self.history, self.trained, self.limiter = spark, history, trained, limiter or RateLimiter()

    def _admit(self, operation: str, context: dict | None) -> None:
        context = only_fields(context or {}, ("ip_address", "username"), "request context")
        self.limiter.enforce(operation, context.get("ip_address", "local"), context.get("username", "anonymous"))

    def _symbols(self, symbols: list[str], market: str) -> DataFrame:
        choice(market, MARKETS, "market")
        if not isinstance(symbols, list) or not all(isinstance(s, str) for s in symbols):
            raise InvalidRequest("symbols must be a list of strings")
        asked = self.spark.createDataFrame([(symbols,)], "s array<string>").select(distinct_symbols(F.col("s"), market).alias("s"))
        if (valid := asked.first().s) is None:
            raise InvalidRequest(f"invalid {market} symbols: {symbols}")
        return self.spark.createDataFrame([(s,) for s in valid], "symbol string")

    def _bars(self, asked: DataFrame, market: str) -> DataFrame:
        return self.history(market).join(F.broadcast(asked), "symbol", "left_semi")  # at most 25 symbols

    def train(self, market: str = "US", context: dict | None = None, **settings: int) -> dict:
        self._admit("train", context)
        choice(market, MARKETS, "market")
        swing, ahead = number(settings.pop("swing_threshold", SWING_THRESHOLD), "swing_threshold"), number(settings.pop("lookforward", LOOKFORWARD), "lookforward")
        self.trained = model.train(model.training_table(self.history(market), ahead, swing), lookforward=ahead, swing=swing, **settings)
        return self.trained.stats

    def _scores(self, asked: DataFrame, market: str) -> DataFrame:
        """Latest analysis: by the model where a symbol has 100 bars and a model is there, else by the fallback score."""
        found = self._bars(asked, market)
        plain = signals.latest_analysis(found, market, min_bars=MIN_BARS)
        if self.trained is None:
            return plain.withColumn("prediction", (F.col("swing_probability") >= MODEL_THRESHOLD).cast("int"))
        ready = signals.enough(model.prepare_for_scoring(found), MIN_MODEL_BARS)
        scored = signals.levels(self.trained.score(bars.last_n(ready, 1)), swing=self.trained.stats["swing_threshold"])
        scored = scored.select("symbol", F.struct("swing_probability", "prediction", "stop_loss", "take_profit", signals.confidence(F.col("swing_probability")).alias("confidence_level")).alias("m"))
        both = plain.join(scored, "symbol", "left")
        pick = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c)
        prediction = F.coalesce("m.prediction", (F.col("swing_probability") >= MODEL_THRESHOLD).cast("int")).alias("prediction")
        return both.select("symbol", "as_of", "current_price", "current_volume", "price_change_1d", "rsi", pick("swing_probability"), prediction, pick("confidence_level"), pick("stop_loss"), pick("take_profit"), "currency")

    def analyze(self, symbol: str, market: str = "US", context: dict | None = None) -> DataFrame:
        self._admit("analyze", context)
        out = self._scores(self._symbols([symbol], market), market)
        return out.withColumn("signal", signals.strength(F.col("swing_probability"), F.col("prediction")))

    def screen(self, symbols: list[str], market: str = "US", context: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(ranked analyses, symbols without one)."""
        self._admit("analyze", context)
        asked = self._symbols(symbols, market)
        found = self._scores(asked, market)
        return signals.screener(found), signals.screener_failures(asked, found)

    def monitor(self, symbols: list[str], market: str = "US", alert: float = MODEL_THRESHOLD, context: dict | None = None) -> DataFrame:
        self._admit("monitor", context)
        return signals.monitor(self._scores(self._symbols(symbols, market), market), alert)

    def backtest(self, symbols: list[str], market: str = "US", days: int = 90, threshold: float = MODEL_THRESHOLD, context: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(trades, summary with Sharpe and drawdown, equity curve) over the last `days`, for symbols with bars enough."""
        self._admit("backtest", context)
        number(days, "days_back")
        recent = signals.enough(bars.time_window(self._bars(self._symbols(symbols, market), market), days), MIN_BARS + LOOKFORWARD + 1)
        if self.trained is None:
            scored = signals.fallback_scores(recursive(with_price(recent)))
        else:
            scored = self.trained.score(model.prepare_for_scoring(recent, zeros=True)).withColumnRenamed("swing_probability", "score")
        steps = backtest.walk(scored, threshold)
        closed, curve = backtest.trades(steps), backtest.equity_curve(steps)
        whole = backtest.summary(closed).join(backtest.sharpe(closed), "symbol").join(backtest.max_drawdown(curve), "symbol", "right")
        return closed, whole, curve
