"""Hand-made series and edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwright.functions import indicators as I
from barwright.functions.exprs import finite, money, pdiv, percent, safe_file_name
from barwright.functions.recursive import Counted, Smoother, SymbolState, recursive
from barwright.operators import backtest, bars, impute, labels, model, ratelimit, signals, validate

START = dt.datetime(2024, 1, 1)


def frame(spark, closes, symbol="A", volume=1.0, spread=1.0):
    rows = [(symbol, START + dt.timedelta(days=i), float(c), c + spread, c - spread, float(c), float(volume)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("symbol", "bar_ts").select(name).collect()]


def test_float_division(spark):
    got = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (6.0, 3.0), (1.0, None)], "a double, b double").select(pdiv(F.col("a"), F.col("b")), finite(pdiv(F.col("a"), F.col("b")))).collect()
    assert [r[0] for r in got] == [math.inf, -math.inf, None, None, 2.0, None] and [r[1] for r in got] == [0.0, 0.0, None, None, 2.0, None]


def test_short_and_constant_series(spark):
    df = I.native(recursive(I.with_price(frame(spark, [5.0] * 30, volume=0.0, spread=0.0))))
    assert column(df, "sma_20")[18:20] == [None, 5.0] and set(column(df, "sma_50")) == {None}
    assert set(column(df, "rsi_14")[13:]) == {100.0} and column(df, "rsi_14")[12] is None
    assert set(column(df, "doji")) == {0} and set(column(df, "stoch_k")) == {None} and set(column(df, "bb_20_position")) == {None}
    assert set(column(df, "volume_sma_20")) == {1.0} and set(column(df, "volume_weighted_price")) == {5.0} and set(column(df, "on_balance_volume")) == {0.0}
    assert column(df, "atr_14")[:13] == [0.0] * 13


def test_known_values(spark):
    df = I.native(recursive(I.with_price(frame(spark, range(1, 41)))))
    assert column(df, "price_change")[:2] == [None, 1.0] and column(df, "price_sma_5_ratio")[3:5] == [None, pytest.approx(5 / 3)]
    assert column(df, "volume_price_trend")[:3] == [None, pytest.approx(1.0), pytest.approx(1.5)]
    assert column(df, "sma_5")[4] == 3 and column(df, "price_momentum_5")[5] == 5 and column(df, "roc_10")[10] == 1000
    assert column(df, "on_balance_volume")[-1] == 40 and column(df, "atr_14")[13] == 2.0 and column(df, "williams_r")[13] == pytest.approx(-100 / 15)
    assert column(df, "ema_5")[:5] == [None] * 4 + [pytest.approx(1 * (2 / 3) ** 4 + sum((1 / 3) * (2 / 3) ** (4 - k) * (k + 1) for k in range(1, 5)))]
    assert column(df, "adx")[26] is None and column(df, "adx")[27] == pytest.approx(100)


def test_symbols_do_not_mix(spark):
    both = bars.stack([frame(spark, range(1, 30)), frame(spark, range(100, 130), "B")])
    alone = recursive(I.with_price(frame(spark, range(100, 130), "B")))
    assert column(recursive(I.with_price(both)).where("symbol = 'B'"), "ema_10") == column(alone, "ema_10")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(1, 100), min_size=3, max_size=80), st.integers(1, 79))
def test_state_carries_over_batches(values, cut):
    p = np.array(values)
    whole, parts = SymbolState().step(p, p + 1, p - 1), SymbolState()
    cut = min(cut, len(p) - 1)
    a, b = (parts.step(x, x + 1, x - 1) for x in (p[:cut], p[cut:]))
    for k, v in whole.items():
        assert np.allclose(v, np.concatenate((a[k], b[k])), equal_nan=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.floats(1, 100), st.just(math.nan)), min_size=1, max_size=60), st.lists(st.integers(0, 60), max_size=4), st.sampled_from([(0.5, 1), (0.2, 5), (1 / 14, 14)]))
def test_summaries_advance_a_smoother_as_its_values_do(values, cuts, kind):
    whole, told = Smoother(*kind), Smoother(*kind)
    for part in np.split(np.array(values), sorted(min(c, len(values)) for c in cuts)):
        whole(part)
        whole.seen += int((~np.isnan(part)).sum())
        told.advance(told.summary(part))
        assert np.allclose(whole.state(), told.state(), equal_nan=True, rtol=1e-12, atol=1e-12)
    again = Smoother(*kind)
    again.restore(told.state())
    assert np.allclose(again.state(), told.state(), equal_nan=True)


def test_smoothers():
    assert Smoother(0.5, 2)(np.array([1.0, 3.0, 4.0]))[1:].tolist() == [2.0, 3.0]
    assert np.isnan(Counted(0.5, 3)(np.array([1.0, np.nan, 2.0]))).all()


def test_labels_end_and_potential(spark):
    df = labels.swing_labels(I.with_price(frame(spark, [100.0] * 5 + [120.0] * 20, spread=0.0)))
    assert column(df, "swing_label")[:6] == [1, 1, 1, 1, 1, 0] and column(df, "swing_profit_potential")[0] == pytest.approx(0.2)
    assert column(df, "swing_label")[-10:] == [0] * 10
    assert labels.swing_labels(I.with_price(frame(spark, range(1, 31))), drop_tail=True).count() == 20
    assert set(column(labels.swing_labels(I.with_price(frame(spark, range(1, 31))), lookforward=2), "swing_label")) == {0}


def test_fill_directions(spark):
    df = frame(spark, range(1, 6)).withColumn("x", F.when(F.col("close").isin(2.0, 4.0), F.col("close")))
    assert column(impute.fill(df, ["x"]), "x") == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert column(impute.fill(df, ["x"], "ffill"), "x") == [None, 2.0, 2.0, 4.0, 4.0]


def test_dedup_and_windows(spark):
    df = frame(spark, range(1, 11))
    assert column(bars.last_n(df, 3), "close") == [8.0, 9.0, 10.0] and column(bars.time_window(df, 2), "close") == [8.0, 9.0, 10.0]
    twice = df.withColumn("n", F.lit(1)).unionByName(df.withColumn("n", F.lit(2)))
    assert set(column(bars.dedup(twice, ["symbol", "bar_ts"], [F.col("n")]), "n")) == {1}


def test_walk_exits(spark):
    closes = [100.0] * 55 + [130.0] + [100.0] * 5 + [80.0] + [100.0] * 40
    scored = frame(spark, closes).withColumns({"atr_14": F.lit(0.0), "score": F.when((F.dayofyear("bar_ts") == 55) | (F.dayofyear("bar_ts") == 60) | (F.dayofyear("bar_ts") == 70), 0.9).otherwise(0.1)})
    closed = backtest.trades(backtest.walk(scored, 0.5)).orderBy("entry_date").collect()
    assert [(r.exit_reason, r.bars_held) for r in closed] == [("Take-profit", 1), ("Stop-loss", 2), ("Max time", 10)]
    assert closed[0].profit_pct == pytest.approx(0.3) and closed[2].days_held == 10
    steps = backtest.walk(scored, 0.5)
    assert column(steps, "equity")[-1] == pytest.approx(1.3 * 0.8)
    got = backtest.summary(backtest.trades(steps)).first()
    assert got.num_trades == 3 and got.total_return == pytest.approx(1.3 * 0.8 - 1)
    assert backtest.max_drawdown(backtest.equity_curve(steps)).first().max_drawdown == pytest.approx(0.2)
    assert backtest.walk(scored, 2.0).where("entry_ts is not null").count() == 0


def test_open_position_is_marked_but_no_trade(spark):
    scored = frame(spark, [100.0] * 60 + [101.0] * 5).withColumns({"atr_14": F.lit(0.0), "score": F.lit(0.9)})
    steps = backtest.walk(scored, 0.5)
    assert backtest.trades(steps).count() == 0 and column(steps, "equity")[-1] == pytest.approx(1.01)


def test_screener_and_dashboard(spark):
    both = bars.stack([frame(spark, range(100, 140)), frame(spark, [100.0] * 40, "B")])
    asked = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "symbol string")
    found = signals.latest_analysis(both)
    assert [r.symbol for r in signals.screener(found).collect()] == ["A", "B"]
    assert [r.symbol for r in signals.screener_failures(asked, found).collect()] == ["C"]
    board = signals.dashboard(asked, both, {"A": "Alpha"}).collect()
    assert [(r.company, r.status) for r in board] == [("Alpha", "available"), ("B", "available"), ("C", "unavailable")]
    assert signals.latest_analysis(both, "KR").first().currency == "KRW" and signals.latest_analysis(both, min_bars=41).count() == 0
    assert signals.monitor(found, 0.99).count() == 0


def test_window_options(spark):
    days = spark.createDataFrame([("long", START), ("long", START + dt.timedelta(days=365 * 11 + 5)), ("short", START)], "symbol string, bar_ts timestamp_ntz")
    got = {(r.symbol, r.days) for r in signals.window_options(days).collect()}
    assert got == {("long", d) for d in (90, 180, 365, 1095, 1825, 3650)} | {("short", 90)}


def test_symbols(spark):
    texts = ["AAPL", " brk-b ", "1ABC", "", "A" * 16, "005930", "etf:069500", "KR7005930003", "삼성전자", "a\tb", "\tMSFT\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(validate.valid_symbol(F.col("t"), "US"), validate.valid_symbol(F.col("t"), "KR")).collect()
    assert [r[0] for r in got] == ["AAPL", "BRK-B", None, None, None, None, None, "KR7005930003", None, None, "MSFT"]
    assert [r[1] for r in got][5:] == ["005930", "ETF:069500", "KR7005930003", "삼성전자", None, "MSFT"]
    lists = spark.createDataFrame([(["B", "A", "b"],), ([],), (["A", "?"],), (["A"] * 26,)], "s array<string>")
    assert [r[0] for r in lists.select(validate.distinct_symbols(F.col("s"), "US")).collect()] == [["B", "A"], None, None, None]


def test_request_checks():
    assert validate.number(0.2, "swing_threshold") == 0.2 and validate.choice("US", ("US", "KR"), "market") == "US"
    for bad in (lambda: validate.number(True, "lookforward"), lambda: validate.number(1, "lookforward"), lambda: validate.number(2.5, "lookforward"), lambda: validate.choice("X", ("US",), "m"), lambda: validate.only_fields({"a": 1}, ("b",), "c"), lambda: validate.only_fields([], (), "c")):
        with pytest.raises(validate.InvalidRequest):
            bad()


def test_rate_limits(spark):
    times = [0, 10, 20, 30, 59, 60, 61, 119]
    rows = [(i, START + dt.timedelta(seconds=s), "ip", "u1" if i % 2 else "u2") for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, ip string, username string")
    got = {r.request_id: (r.accepted, r.retry_after) for r in ratelimit.replay_limit(df, "ip", 3, 60).collect()}
    assert [got[i][0] for i in range(8)] == [True, True, True, False, False, True, False, True] and got[3][1] == 30.0 and got[4][1] == 1.0
    both = {r.request_id: (r.address_ok, r.user_ok) for r in ratelimit.replay(df, "ip", "username", 3, 1).collect()}
    assert both[0] == (True, True) and both[2] == (True, False) and both[3] == (False, None)


def test_formats(spark):
    df = spark.createDataFrame([(0.0123, 1234.5, "USD", "^GS/PC"), (-0.5, 1234.5, "KRW", " A ")], "p double, m double, c string, s string")
    got = df.select(percent(F.col("p")), money(F.col("m"), F.col("c")), safe_file_name(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("+1.2%", "$1,234.50", "GS_PC"), ("-50.0%", "KRW 1,234", "A")]


def test_split_and_report(spark):
    rows = labels.swing_labels(I.with_price(frame(spark, [100 + 20 * math.sin(i / 4) for i in range(300)])))
    parts = {(r.swing_label, r.is_train): r["count"] for r in model.split(rows).groupBy("swing_label", "is_train").count().collect()}
    for label in (0, 1):
        n = parts[label, True] + parts[label, False]
        assert parts[label, True] == int(n * 0.8)
    flat = labels.swing_labels(I.with_price(frame(spark, [100.0] * 100, spread=0.0)))
    cut = model.split(flat).groupBy("is_train").agg(F.min("bar_ts").alias("a"), F.max("bar_ts").alias("b"), F.count("*").alias("n")).collect()
    by = {r.is_train: r for r in cut}
    assert by[True].n == 80 and by[True].b < by[False].a
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "swing_label int, prediction int")
    got = {r.label: r for r in model.report(scored).collect()}
    assert got["1"].precision == 1.0 and got["1"].recall == 0.5 and got["0"].support == 2 and got["1"].f1 == pytest.approx(2 / 3)
    assert got["accuracy"].f1 == 0.75 and got["macro avg"].recall == 0.75 and got["weighted avg"].precision == pytest.approx((2 * 2 / 3 + 2 * 1) / 4)
    assert {r.precision for r in model.report(scored.limit(0)).collect()} <= {0.0, None}


def test_cut_in_time_is_exact(spark):
    rows = spark.range(1000).selectExpr("concat('s', id % 50) AS symbol", "cast(timestamp_seconds(1700000000 + 60 * cast(id / 50 as int)) as timestamp_ntz) AS bar_ts")
    for share in (0.0, 0.333, 0.8, 0.8127, 1.0):
        got = sorted((r.bar_ts, r.symbol, r.is_train) for r in model.first_in_time(rows, share).collect())
        n = int(1000 * share)
        assert [g[2] for g in got] == [True] * n + [False] * (1000 - n), share
    old = spark.sql("SELECT 'a' AS symbol, timestamp_ntz'1890-05-01' AS bar_ts UNION ALL SELECT 'a', timestamp_ntz'2500-01-01 00:00:00.000001' UNION ALL SELECT 'a', timestamp_ntz'2500-01-01 00:00:00.000002'")
    assert sorted((r.bar_ts, r.is_train) for r in model.first_in_time(old, 0.7).collect()) == [(r, k < 2) for k, r in enumerate(sorted(r.bar_ts for r in old.collect()))]


def test_train_save_load(spark, tmp_path):
    data = bars.stack([frame(spark, [100 + 15 * math.sin(i / 5 + k) + (i * 7919 % 13) for i in range(260)], f"S{k}") for k in range(2)])
    names = ["price_change", "rsi_14", "stoch_k", "price_momentum_10"]
    rows = model.training_table(data).persist()
    with pytest.raises(ValueError, match="training rows"):
        model.train(rows, names, min_rows=10_000)
    trained = model.train(rows, names, trees=5, rounds=2, depths=(3, 2), min_rows=100)
    assert 0 <= trained.stats["test_score"] <= 1 and trained.stats["training_samples"] + trained.stats["test_samples"] == rows.count()
    trained.save(spark, str(tmp_path))
    again = model.Ensemble.load(spark, str(tmp_path))
    a, b = ({(r.symbol, r.bar_ts): r.swing_probability for r in m.score(rows).collect()} for m in (trained, again))
    assert a == b and all(0 <= p <= 1 for p in a.values())
    assert set(trained.score(rows).columns) == {*rows.columns, "swing_probability", "boosted_probability", "prediction"}
    test = trained.score(model.split(rows).where("not is_train"))
    assert trained.stats["mean_positive_probability"] == pytest.approx(test.agg(F.avg("swing_probability")).first()[0])
    assert trained.stats["test_score"] == pytest.approx(test.agg(F.avg((F.col("prediction") == F.col("swing_label")).cast("double"))).first()[0])
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(str(tmp_path / "stats"))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    bare = model.Ensemble.load(spark, str(tmp_path))
    assert (bare.stats["decision_threshold"], bare.stats["lookforward_periods"], bare.stats["swing_threshold"]) == (0.70, 10, 0.15)
    with pytest.raises(ValueError, match="no model"):
        model.Ensemble.load(spark, str(tmp_path / "none"))
    with pytest.warns(UserWarning, match="positive"):
        few = rows.where("swing_label = 0").unionByName(rows.where("swing_label = 1").limit(3))
        model.train(few, names, trees=1, rounds=1, depths=(2, 2), min_rows=10, swing=0.3, lookforward=5).stats["swing_threshold"] == 0.3
    ready = model.prepare_for_scoring(frame(spark, range(1, 120)))
    assert ready.where("sma_200 is null or rsi_14 is null").count() == 0 and column(ready, "sma_200")[-1] == pytest.approx(109.5)


def test_filling_looks_at_no_row_from_every_other(spark):
    """Frames from each row to the last would cost the square of a history."""
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("b", 1, None)], "symbol string, bar_ts int, x double")
    filled = impute.fill(df, ["x"])
    assert "currentrow$(), unboundedfollowing$()" not in filled._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.symbol, r.bar_ts, r.x) for r in filled.collect()) == [("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 2.0), ("b", 1, None)]
