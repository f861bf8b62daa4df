"""Types, names and settings shared by the bar operators."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("bar_ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)

# Fixed settings of the method.
LOOKFORWARD = 10
SWING_THRESHOLD = 0.15
HOLD = 3
MIN_LABEL_MOVE = 0.05
MODEL_THRESHOLD = 0.65
DEFAULT_THRESHOLD = 0.70
FALLBACK_SWING = {"US": 0.08, "KR": 0.05}
MA_PERIODS = (5, 10, 20, 50, 100, 200)
BAND_PERIODS = (20, 50)
SHORT_PERIODS = (5, 10, 20)
LAGS = (1, 2, 3, 5)
LAGGED = ("price_change", "rsi_14", "macd_histogram", "volume_ratio", "atr_14")
MIN_BARS = 50
MIN_MODEL_BARS = 100
MIN_TRAINING_ROWS = 500
MAX_SYMBOLS = 25


def features() -> list[str]:
    """The 108 feature columns, in order."""
    out = ["price_change", "high_low_range", "open_close_change", "body_size", "upper_shadow", "lower_shadow"]
    for n in MA_PERIODS:
        out += [f"sma_{n}", f"ema_{n}", f"price_sma_{n}_ratio", f"price_ema_{n}_ratio", f"sma_{n}_slope", f"ema_{n}_slope"]
    for n in (14, 21):
        out += [f"rsi_{n}", f"rsi_{n}_change"]
    out += ["macd", "macd_signal", "macd_histogram", "macd_crossover"]
    for n in BAND_PERIODS:
        out += [f"bb_{n}_{x}" for x in ("middle", "upper", "lower", "width", "position", "squeeze")]
    out += ["volume_sma_20", "volume_ratio", "volume_price_trend", "on_balance_volume", "volume_weighted_price"]
    out += ["atr_14", "atr_21", "volatility_ratio", "roc_10", "roc_20", "williams_r", "stoch_k", "stoch_d", "adx", "cci", "doji", "hammer"]
    out += [f"{c}_lag_{k}" for c in LAGGED for k in LAGS]
    for n in SHORT_PERIODS:
        out += [f"price_volatility_{n}", f"price_momentum_{n}", f"high_low_volatility_{n}"]
    return out
