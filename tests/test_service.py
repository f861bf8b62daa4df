import math

import pytest

from barwright.operators import backtest, bars, model
from barwright.operators.validate import InvalidRequest
from barwright.plans.service import RateLimiter, Service, TooManyRequests
from barwright.sources.cache import HistoryCache
from tests.test_operators import frame


@pytest.fixture(scope="module")
def history(spark):
    wave = lambda k, n: [100 + 15 * math.sin(i / 5 + k) + (i * 7919 % 13) for i in range(n)]
    out = bars.stack([frame(spark, wave(0, 260), "AAA"), frame(spark, wave(1, 260), "BBB"), frame(spark, wave(2, 70), "CCC"), frame(spark, wave(3, 10), "DDD")]).persist()
    yield out
    out.unpersist()


def test_screen_with_and_without_a_model(spark, history, tmp_path):
    service = Service(spark, lambda market: history)
    ranked, failed = service.screen(["aaa", "BBB", "CCC", "DDD", "ZZZ", "AAA"])
    first = {r.symbol: r.swing_probability for r in ranked.collect()}
    assert first.keys() == {"AAA", "BBB", "CCC"} and {r.symbol for r in failed.collect()} == {"DDD", "ZZZ"}
    stats = service.train(trees=5, rounds=2, depths=(3, 2), min_rows=100, names=["price_change", "rsi_14", "stoch_k"])
    assert stats["lookforward_periods"] == 10
    again = {r.symbol: r for r in service.screen(["AAA", "BBB", "CCC"])[0].collect()}
    assert again["CCC"].swing_probability == pytest.approx(first["CCC"]) and again["AAA"].swing_probability != first["AAA"]
    assert service.analyze("AAA").first().signal in ("NO BUY", "WEAK BUY", "MODERATE BUY", "STRONG BUY")
    assert service.monitor(["AAA"], alert=0.0).count() == 1
    service.trained.save(spark, str(tmp_path / "m"))
    assert all(model.Ensemble.present(spark, str(tmp_path / "m")).values()) and not any(model.Ensemble.present(spark, str(tmp_path / "x")).values())


def test_backtest(spark, history, tmp_path):
    closed, whole, curve = Service(spark, lambda market: history).backtest(["AAA", "CCC", "DDD"], days=365, threshold=0.5)
    assert {r.symbol for r in whole.collect()} == {"AAA", "CCC"} and curve.count() == 330
    backtest.export(closed, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == closed.count() > 0


def test_bad_requests(spark, history):
    service = Service(spark, lambda market: history)
    for bad in (lambda: service.screen([]), lambda: service.screen(["?"]), lambda: service.screen("AAA"), lambda: service.analyze("AAA", "XX"), lambda: service.analyze("AAA", context={"x": 1}), lambda: service.backtest(["AAA"], days=1)):
        with pytest.raises(InvalidRequest):
            bad()


def test_limits_and_what_is_recorded():
    now = [0.0]
    limiter = RateLimiter(lambda: now[0])
    for _ in range(3):
        limiter.enforce("train", "ip", "user")
    with pytest.raises(TooManyRequests) as e:
        limiter.enforce("train", "ip", "user")
    assert e.value.reply["status"] == 429 and e.value.reply["retry_after_seconds"] == 3600
    limiter.enforce("train", "ip", "other")  # the rejected one counts for the address: this is its fifth
    with pytest.raises(TooManyRequests):
        limiter.enforce("train", "ip", "third")
    now[0] = 3600
    limiter.enforce("train", "ip", "user")


def test_cache_lifetimes(spark):
    now, loads = [0.0], []
    cache = HistoryCache(lambda: now[0])
    get = lambda market: cache.get(market, "A", "full", lambda: loads.append(market) or spark.range(1))
    for _ in range(2):
        get("US"), get("KR")
    now[0] = 1000
    get("US"), get("KR")
    assert loads == ["US", "KR", "KR"]
    cache.clear()
