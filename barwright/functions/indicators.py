"""Technical indicators that windows can express. Each function adds columns to bars that carry a price `p`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.schema import BAND_PERIODS, LAGGED, LAGS, MA_PERIODS, SHORT_PERIODS

from .exprs import before, by_symbol, change, last_rows, pdiv, rolling, whole

_c = F.col


def with_price(bars: DataFrame) -> DataFrame:
    """p: the adjusted close where the table has one, else the close."""
    return bars.withColumn("p", F.col("adj_close" if "adj_close" in bars.columns else "close"))


def price_change(df: DataFrame) -> DataFrame:
    return df.withColumn("price_change", change(_c("p"), 1))


def candle_shape(df: DataFrame) -> DataFrame:
    o, h, low, p = (_c(x) for x in ("open", "high", "low", "p"))
    return df.withColumns({
        "high_low_range": pdiv(h - low, p), "open_close_change": pdiv(p - o, o), "body_size": pdiv(F.abs(p - o), p),
        "upper_shadow": pdiv(h - F.greatest(o, p), p), "lower_shadow": pdiv(F.least(o, p) - low, p),
    })


def sma(df: DataFrame, periods: tuple[int, ...] = MA_PERIODS) -> DataFrame:
    return df.withColumns({f"sma_{n}": rolling(F.avg, _c("p"), n) for n in periods})


def average_ratios(df: DataFrame, kind: str, periods: tuple[int, ...] = MA_PERIODS) -> DataFrame:
    """Price over a moving average (`sma` or `ema`), and the average's change over five bars."""
    return df.withColumns({f"price_{kind}_{n}_ratio": pdiv(_c("p"), _c(f"{kind}_{n}")) for n in periods} | {f"{kind}_{n}_slope": change(_c(f"{kind}_{n}"), 5) for n in periods})


def bollinger(df: DataFrame, periods: tuple[int, ...] = BAND_PERIODS) -> DataFrame:
    """Bands of two population deviations, their width and the price's place in them."""
    for n in periods:
        df = df.withColumns({f"bb_{n}_middle": rolling(F.avg, _c("p"), n), "_dev": rolling(F.stddev_pop, _c("p"), n)})
        middle = _c(f"bb_{n}_middle")
        df = df.withColumns({f"bb_{n}_upper": middle + 2 * _c("_dev"), f"bb_{n}_lower": middle - 2 * _c("_dev")}).drop("_dev")
        upper, low = _c(f"bb_{n}_upper"), _c(f"bb_{n}_lower")
        df = df.withColumns({f"bb_{n}_width": pdiv(upper - low, middle), f"bb_{n}_position": pdiv(_c("p") - low, upper - low)})
    return df


def bollinger_squeeze(df: DataFrame, periods: tuple[int, ...] = BAND_PERIODS) -> DataFrame:
    """1 where the width is under its mean over 20 bars."""
    return df.withColumns({f"bb_{n}_squeeze": F.coalesce((_c(f"bb_{n}_width") < rolling(F.avg, _c(f"bb_{n}_width"), 20)).cast("int"), F.lit(0)) for n in periods})


def volume_features(df: DataFrame) -> DataFrame:
    """Volume mean and ratio, price-volume trend, on-balance volume, weighted price; constants for a symbol without volume."""
    p, v = _c("p"), _c("volume")
    traded = _c("_traded") if "_traded" in df.columns else F.sum("volume").over(whole()) > 0
    last = before(p, 1)
    typical = (_c("high") + _c("low") + p) / 3
    df = df.withColumns({"_mean": rolling(F.avg, v, 20), "_step": (pdiv(p, last) - 1) * v, "_flow": F.when(p < last, -v).otherwise(v), "_tp": typical * v})
    running = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "volume_sma_20": F.when(traded, _c("_mean")).otherwise(1.0), "volume_ratio": F.when(traded, pdiv(v, _c("_mean"))).otherwise(1.0),
        "volume_price_trend": F.when(traded, F.when(_c("_step").isNotNull(), F.sum("_step").over(running))).otherwise(0.0),
        "on_balance_volume": F.when(traded, F.sum("_flow").over(running)).otherwise(0.0),
        "volume_weighted_price": F.when(traded, pdiv(rolling(F.sum, _c("_tp"), 14), rolling(F.sum, v, 14))).otherwise(p),
    }).drop("_mean", "_step", "_flow", "_tp")


def rate_of_change(df: DataFrame) -> DataFrame:
    return df.withColumns({f"roc_{n}": 100 * pdiv(_c("p") - before(_c("p"), n), before(_c("p"), n)) for n in (10, 20)})


def channel(df: DataFrame) -> DataFrame:
    """Williams %R, stochastic %K and its mean %D, over 14 bars."""
    top, low = rolling(F.max, _c("high"), 14), rolling(F.min, _c("low"), 14)
    df = df.withColumns({"williams_r": -100 * pdiv(top - _c("p"), top - low), "stoch_k": 100 * pdiv(_c("p") - low, top - low)})
    return df.withColumn("stoch_d", rolling(F.avg, _c("stoch_k"), 3))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index; the mean deviation is about each window's own mean."""
    df = df.withColumn("_tp", (_c("high") + _c("low") + _c("p")) / 3)
    df = df.withColumns({"_mean": rolling(F.avg, _c("_tp"), n), "_all": F.collect_list("_tp").over(last_rows(n))})
    spread = F.aggregate("_all", F.lit(0.0), lambda total, x: total + F.abs(x - _c("_mean"))) / n
    return df.withColumn("cci", pdiv(_c("_tp") - _c("_mean"), 0.015 * spread)).drop("_tp", "_mean", "_all")


def candle_patterns(df: DataFrame) -> DataFrame:
    o, h, low, p = (_c(x) for x in ("open", "high", "low", "p"))
    doji = F.coalesce(pdiv(F.abs(p - o), h - low) < 0.1, F.lit(False))
    hammer = F.coalesce((low < F.least(o, p)) & (h - F.greatest(o, p) < 0.3 * (h - low)), F.lit(False))
    return df.withColumns({"doji": doji.cast("int"), "hammer": hammer.cast("int")})


def lags(df: DataFrame, columns: tuple[str, ...] = LAGGED) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": before(_c(c), k) for c in columns for k in LAGS})


def volatility(df: DataFrame) -> DataFrame:
    """Sample deviations of price_change and high_low_range."""
    return df.withColumns({f"price_volatility_{n}": rolling(F.stddev_samp, _c("price_change"), n) for n in SHORT_PERIODS} | {f"high_low_volatility_{n}": rolling(F.stddev_samp, _c("high_low_range"), n) for n in SHORT_PERIODS})


def momentum(df: DataFrame) -> DataFrame:
    return df.withColumns({f"price_momentum_{n}": change(_c("p"), n) for n in SHORT_PERIODS})


def native(df: DataFrame) -> DataFrame:
    """Every indicator here that needs no recursive one."""
    for f in (price_change, candle_shape, sma, lambda d: average_ratios(d, "sma"), bollinger, bollinger_squeeze, volume_features, rate_of_change, channel, cci, candle_patterns, volatility, momentum):
        df = f(df)
    return df
