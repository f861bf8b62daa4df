import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barwright.functions import indicators as I
from barwright.functions.features import all_features, slices_for
from barwright.functions.recursive import COLUMNS, recursive
from barwright.functions.scan import recursive_scan, running, with_slices
from barwright.functions.slices import running_sums, sliced
from barwright.operators import backtest, impute
from barwright.operators.bars import hourly_bars, stack
from barwright.operators.labels import swing_labels
from barwright.schema import features
from tests.conftest import DATA
from tests.test_operators import START, column, frame


@pytest.fixture(scope="module")
def bars(spark):
    b = hourly_bars(spark.read.parquet(f"{DATA}/sf0.01/events.parquet"))
    out = stack([b, frame(spark, [5.0] * 60, "still", volume=0.0)]).persist()
    yield out
    out.unpersist()


def rows(df, names):
    return {(r.symbol, r.bar_ts): [r[c] for c in names] for r in df.select("symbol", "bar_ts", *names).collect()}


def test_windows_in_slices_are_those_of_the_whole(bars):
    f = lambda d: I.sma(d, (5, 50))
    df = I.with_price(bars)
    names = ["sma_5", "sma_50"]
    whole, cut = rows(f(df), names), rows(sliced(df, f, back=50, rows=64), names)
    assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(v) for k, v in whole.items())
    with pytest.raises(ValueError, match="slice"):
        sliced(df, f, back=50, rows=10)


def test_looking_ahead(bars):
    df = I.with_price(bars)
    up = lambda d: d.withColumn("x", F.lead("close", 10).over(I.by_symbol()))
    assert rows(sliced(df, up, back=0, ahead=10, rows=40), ["x"]) == rows(up(df), ["x"])
    assert swing_labels(df).count() == df.count()


def test_features_in_slices(bars):
    names = features()
    whole, cut = rows(all_features(bars), names), rows(all_features(bars, slice_rows=400), names)
    assert whole.keys() == cut.keys()
    for k, v in whole.items():
        for name, a, b in zip(names, v, cut[k], strict=True):
            assert (a is None) == (b is None) and (a is None or a == b or a == pytest.approx(b, rel=1e-5, abs=1e-5)), (k, name)
    assert slices_for(bars) is None


def test_running_sums_over_months(spark):
    df = frame(spark, range(1, 101)).withColumn("x", F.when(F.col("close") % 7 != 0, F.col("close")))
    got, total = column(running_sums(df, {"s": "x"}), "s"), 0
    for i, s in enumerate(got, 1):
        total += i if i % 7 else 0
        assert s == (total if i % 7 else None)


def test_scan_is_exact_for_one_long_history(spark):
    """A symbol with 95 % of the bars, in some 50 slices: the values of one pass, and no task with over twice the median's bars."""
    spread = lambda i: math.sin(i / 9) * 8 + (i * 7919 % 101) / 10 + 60
    rows = [(s, START + dt.timedelta(days=i), *(spread(i * k) + d for d in (0.0, 1.0 + i % 3, -1.0 - i % 5, 0.0)), 1.0) for s, k, n in (("long", 1, 5000), ("short", 2, 260), ("one", 1, 1)) for i in range(n)]
    df = I.with_price(spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")).withColumn("p", F.when(F.col("close") % 7 > 1, F.col("close")))
    whole, cut = rows_of(recursive(df)), rows_of(recursive_scan(df, rows=100))
    assert whole.keys() == cut.keys() and len(whole) == 5261
    for k, v in whole.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-10)) for a, b in zip(v, cut[k], strict=True)), k
    sizes = [r["count"] for r in with_slices(df, 100).where("symbol = 'long'").groupBy("_slice").count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 131 <= 2 * sorted(sizes)[len(sizes) // 2]


def rows_of(df):
    return rows(df, COLUMNS)


def test_running_values_over_months(spark):
    df = frame(spark, [3, 9, 2, 8] * 60).withColumn("x", F.when((F.col("close") == 8) & (F.dayofyear("bar_ts") > 70), F.dayofyear("bar_ts").cast("double")))
    got = running(df, past={"a": "x"}, future={"b": "x"}, peaks={"c": "x"}, first={"d": "close"}).orderBy("bar_ts").collect()
    x = [r.x for r in got]
    known = [(i, v) for i, v in enumerate(x) if v is not None]
    for i, r in enumerate(got):
        assert r.a == max((v for j, v in known if j <= i), default=None) == r.c and r.b == min((v for j, v in known if j >= i), default=None) and r.d == 3.0
    both = impute.fill_long(df, ["x"])
    assert both.columns == df.columns and rows(both, ["x"]) == rows(impute.fill(df, ["x"]), ["x"]) and rows(impute.fill_long(df, ["x"], "ffill"), ["x"]) == rows(impute.fill(df, ["x"], "ffill"), ["x"])
    assert backtest.max_drawdown(df.withColumn("equity", F.col("close"))).first().max_drawdown == pytest.approx(7 / 9)
    plan = backtest.buy_hold(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_pointer_doubling_walks_as_the_walk_does(spark):
    import random

    r = random.Random(6)
    rows = []
    for symbol, n, often in (("long", 1500, 0.3), ("calm", 90, 0.1), ("none", 80, 0.0), ("all", 100, 1.0), ("few", 12, 1.0)):
        price = 100.0
        for i in range(n):
            price *= 1 + r.uniform(-0.12, 0.12)
            rows.append((symbol, START + dt.timedelta(days=i), price, 0.9 if r.random() < often else 0.1, 2.0))
    scored = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, close double, score double, atr_14 double")
    want, got = ({(x.symbol, x.bar_ts): x for x in f.collect()} for f in (backtest.walk(scored, 0.5), backtest.walk_long(scored, 0.5, slice_rows=50)))
    assert want.keys() == got.keys() and sum(x.exit_reason is not None for x in want.values()) > 100
    for k, a in want.items():
        b = got[k]
        assert (a.entry_ts, a.exit_reason, a.bars_held, a.entry_price, a.entry_probability) == (b.entry_ts, b.exit_reason, b.bars_held, b.entry_price, b.entry_probability), k
        assert a.equity == pytest.approx(b.equity, rel=1e-9) and (a.profit_pct is None) == (b.profit_pct is None) and (a.profit_pct is None or a.profit_pct == pytest.approx(b.profit_pct))
