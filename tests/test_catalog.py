import pytest

import __spark_entry__
from barwright.plans import catalog
from barwright.schema import features
from tests.conftest import DATA
from tests.oracle import check, connect

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


MODELS = {"feature_importance", "detect_latest", "ensemble_scores", "ensemble_report", "boosted_scores", "model_artifacts"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql().keys() - MODELS))
def test_query_matches_its_statement(spark, con, name):
    check(spark, con, SMALL, catalog.queries()[name], catalog.oracle_sql()[name])


def test_queries_without_a_statement_run(spark):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys() - MODELS:
        assert catalog.queries()[name](spark, SMALL).count() > 0


def test_model_queries_on_a_small_fit(spark, con, monkeypatch):
    train = catalog.model.train
    some = ["price_change", "upper_shadow", "stoch_k", "doji", "roc_10", "price_momentum_5", "volume_ratio"]
    monkeypatch.setattr(catalog, "TRAINED", {})
    monkeypatch.setattr(catalog.model, "features", lambda: some)  # histories are too short for 200 bars
    monkeypatch.setattr(catalog.model, "train", lambda rows: train(rows, trees=4, rounds=3, depths=(3, 2), min_rows=100))
    check(spark, con, SMALL, catalog.queries()["model_artifacts"], catalog.oracle_sql()["model_artifacts"])
    scored = catalog.ensemble_scores(spark, SMALL)
    got = {r.symbol: r for r in catalog.detect_latest(spark, SMALL).collect()}
    assert scored.columns[2:] == ["swing_probability", "prediction", "swing_label"] and scored.count() == catalog.boosted_scores(spark, SMALL).count() > 100
    assert len(got) == 5 and all(r.stop_loss < r.close < r.take_profit and 0 <= r.swing_probability <= 1 for r in got.values())
    assert catalog.ensemble_report(spark, SMALL).count() == 5 and catalog.feature_importance(spark, SMALL).count() == len(some)
    assert len(catalog.TRAINED) == 1


def test_model_queries_train_at_full_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog, "TRAINED", {})
    monkeypatch.setattr(catalog.model, "train", lambda rows, *given, **named: asked.append((set(features()) <= set(rows.columns), given, named)))
    catalog._ensemble(spark, SMALL)
    assert asked == [(True, (), {})]


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() == 5 and "swing_probability" in got.columns
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_all_features_are_there(spark):
    got = catalog.all_indicators(spark, SMALL)
    assert set(features()) <= set(got.columns) and len(features()) == len(set(features())) == 108
    ranges = got.selectExpr("min(rsi_14) AS a", "max(rsi_14) AS b", "count_if(bb_20_lower > bb_20_middle or bb_20_middle > bb_20_upper) AS c", "count(sma_200) AS d", "min(adx) AS e", "max(adx) AS f").first()
    assert 0 <= ranges.a <= ranges.b <= 100 and ranges.c == 0 and ranges.d == 0 and 0 <= ranges.e <= ranges.f <= 100


def test_indicators_share_one_exchange(spark):
    from barwright.functions.indicators import native, with_price

    frame = native(with_price(spark.createDataFrame([], "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


def test_scan_reads_only_what_a_query_needs(spark):
    plan = catalog.bars_hourly(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema:")[1].split("\n")[0] and "user_id" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_model_queries_start_at_the_written_training_table(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TRAINED", {})
    monkeypatch.setattr(catalog.model, "train", lambda rows: None)
    first, again = catalog._ensemble(spark, SMALL)[1], catalog._ensemble(spark, SMALL)[1]
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert first is again and plan.count("\n") == 1 and "parquet" in plan  # and none of the windows of 108 features
