import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barwright.functions import indicators as I
from barwright.functions.recursive import COLUMNS, recursive
from barwright.operators.bars import hourly_bars
from barwright.operators.signals import latest_analysis
from barwright.schema import BARS
from barwright.session import shared_dir
from barwright.sources import loader, providers
from barwright.streaming.indicators import stream_recursive
from barwright.streaming.monitor import monitor_stream, stream_bars
from tests.conftest import DATA

HEADER = "Date,Open,High,Low,Close,Volume,Adj Close,Note"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "AAA_historical.csv").write_text(f"{HEADER}\n2024-01-03,3,4,2,3,10,2.5,x\n2024-01-02T00:00:00-05:00,2,3,1,2,10,1.5,x\n2024-01-03,9,9,9,9,9,9,dup\nnever,1,1,1,1,1,1,x\n2024-01-04,1,n/a,1,1,1,1,x\n")
    (tmp_path / "BBB.csv").write_text("Date, Open ,High,Low,Close,Volume\n2024-01-02,1,1,1,1,0\n")
    (tmp_path / "CCC.csv").write_text("Open,High,Low,Close,Volume\n1,1,1,1,1\n")
    (tmp_path / "DDD.csv").write_text("Date,Open,High,Low,Close\n2024-01-02,1,1,1,1\n")
    (tmp_path / "FFF.csv").write_text("")
    (tmp_path / "GGG.csv").write_text("Date,Open,High,Low,Close,Volume," + ",".join(f"x{i}" for i in range(70)) + "\n")
    (tmp_path / "HHH.csv").write_text("\ufeffVolume,\"Close\",Open,High,Low, Date ,\"Odd, Name\"\r\n5,1,1,1,1,2024-01-02,\"a, b\"\r\n")
    return tmp_path


def test_load_history(spark, folder):
    spark.createDataFrame([("2024-01-05", 1.0, 2.0, 0.5, 1.5, 7.0)], "Date string, Open double, High double, Low double, Close double, Volume double").coalesce(1).write.parquet(str(folder / "tmp"))
    next((folder / "tmp").glob("part-*.parquet")).rename(folder / "EEE.parquet")
    found, rejected = loader.load_history(spark, str(folder))
    got = {(r.symbol, str(r.bar_ts)[:10]): r for r in found.collect()}
    assert got.keys() == {("AAA", "2024-01-02"), ("AAA", "2024-01-03"), ("BBB", "2024-01-02"), ("EEE", "2024-01-05"), ("HHH", "2024-01-02")}
    assert got["AAA", "2024-01-03"].close == 3 and got["AAA", "2024-01-03"].adj_close == 2.5 and got["BBB", "2024-01-02"].adj_close == 1
    assert str(got["AAA", "2024-01-02"].bar_ts) == "2024-01-02 05:00:00"
    assert sorted(map(tuple, rejected.collect())) == [("CCC.csv", "no Date column"), ("DDD.csv", "missing columns: volume")]


def test_many_files_are_one_read(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"S{i}.csv").write_text(("Date,Open,High,Low,Close,Volume" if i % 3 else "Date,Close,Open,High,Low") + f"\n2024-01-02,{i},2,3,4,5\n")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many", "many")
    found, rejected = loader.load_history(spark, str(tmp_path))
    assert found.where("open = cast(substring(symbol, 2) as double)").count() == 400 and rejected.where("reason = 'missing columns: volume'").count() == 200
    assert len(jobs.getJobIdsForGroup("many")) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_nothing_to_load(spark, tmp_path):
    (tmp_path / "X.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no usable history"):
        loader.load_history(spark, str(tmp_path))


def test_write_history(spark, tmp_path):
    bars = hourly_bars(spark.read.parquet(f"{DATA}/sf0.001/events.parquet"))
    loader.write_history(bars.withColumn("symbol", F.concat(F.lit("^"), "symbol")), str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == bars.count() and again.where("file LIKE '^%'").count() == 0


def test_file_symbols(spark):
    names = ["A_historical.csv", "B.xlsx", "C.parquet", "D", "E.F.csv", "G.txt"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(loader.file_symbol(F.col("n"))).collect()
    assert [r[0] for r in got] == ["A", "B", "C", "D", "E.F", "G"]


def raw(spark, *payloads):
    return spark.createDataFrame([(f"S{i}", p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)], "symbol string, payload string")


def test_us_payloads(spark):
    day = {"Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "5. volume": "9"}, "2024-01-03": {"open": "7", "4. close": "8"}}}
    got = {str(r.bar_ts): r for r in providers.us_daily(raw(spark, day)).collect()}
    assert got["2024-01-02 00:00:00"].close == 1.5 and got["2024-01-03 00:00:00"].open == 7 and got["2024-01-03 00:00:00"].high == 0
    notes = raw(spark, day, {"Error Message": "x"}, {"Note": "x"}, {"Information": "a premium endpoint"}, {"Information": "x"}, {}, {"data": []})
    assert [r[0] for r in notes.select(providers.us_status(F.col("payload"))).collect()] == ["ok", "error", "rate_limited", "premium", "rate_limited", "empty", "ok"]
    oil = providers.us_commodity(raw(spark, {"data": [{"date": "2024-01-01", "value": "70.5"}, {"date": "2024-01-02", "value": "."}]})).collect()
    assert [(r.open, r.close, r.volume) for r in oil] == [(70.5, 70.5, 0.0)]


def kr(items, code="00"):
    return {"response": {"header": {"resultCode": code}, "body": {"totalCount": 1, "items": {"item": items}}}}


def test_kr_payloads(spark):
    item = {"basDt": "20240102", "clpr": "1,234", "srtnCd": "005930", "itmsNm": "N"}
    xml = "<response><header><resultCode>00</resultCode></header><body><items><item><basDt>20240103</basDt><clpr>5</clpr><mkp>4</mkp></item></items></body></response>"
    status = raw(spark, kr([item]), kr(item, "30"), kr(item, "99"), "", None, "Unauthorized", xml)
    assert [r[0] for r in status.select(providers.kr_status(F.col("payload"))).collect()] == ["ok", "auth", "error", "empty", "empty", "auth", "ok"]
    items = providers.kr_items(raw(spark, kr([item, {**item, "clpr": "7"}]), kr(item), xml))
    got = {r.symbol: r for r in providers.kr_bars(items).collect()}
    assert got["S0"].close == 7 and got["S0"].open == 7 and got["S0"].volume == 0 and got["S1"].close == 1234 and got["S2"].open == 4
    assert providers.kr_bars(providers.kr_items(raw(spark, kr([{**item, "basDt": "bad"}, {**item, "clpr": None}])))).count() == 0


def test_kr_selection(spark):
    rows = [("005930", 0, "005930", None, "A"), ("005930", 1, "1", None, "B"), ("Name", 0, "1", None, "Name"), ("Name", 1, "2", None, "Name"), ("Name", 2, "2", None, "Name"), ("Name", 3, "3", None, "Else"), ("Gone", 0, "1", None, "x"), ("Gone", 1, "2", None, "y"), ("KR1234567890", 0, "1", "KR0", "x")]
    items = spark.createDataFrame(rows, "symbol string, place int, srtnCd string, isinCd string, itmsNm string")
    got = sorted((r.symbol, r.place) for r in providers.kr_select(items).collect())
    assert got == [("005930", 0), ("Gone", 0), ("KR1234567890", 0), ("Name", 1), ("Name", 2)]
    assert sorted((r.symbol, r.place) for r in providers.kr_select(items.withColumn("symbol", F.concat(F.lit("Stock: "), "symbol"))).collect()) == [(f"Stock: {a}", b) for a, b in got]


def test_lookups(spark):
    asked = spark.createDataFrame([(s,) for s in ("ETF:069500", "KR7005930003", " A ", "future:x", "005930", "None:y", "", None, "etf:")], "symbol string")
    got = {}
    for r in providers.kr_candidates(asked, F.lit("2024-03-31").cast("date")).orderBy("symbol", "place").collect():
        got.setdefault(r.symbol, []).append((r.kind, r.parameter, r.value, r.begin_day, r.end_day))
    assert got["ETF:069500"] == [("etf", "likeSrtnCd", "069500", "20230131", "20240331")] and "future:x" not in got
    assert [x[:3] for x in got["KR7005930003"][:3]] == [("stock", "isinCd", "KR7005930003"), ("stock", "likeIsinCd", "KR7005930003"), ("etf", "isinCd", "KR7005930003")] and len(got["KR7005930003"]) == 16
    assert got[" A "][0][:3] == ("stock", "itmsNm", "A") and got["None:y"][0][2] == "None:y" and got["etf:"][0][2] == "etf:" and len(got["005930"]) == 8
    answer = lambda kind, parameter, value, items: (kind, parameter, value, json.dumps(kr(items)))
    answers = spark.createDataFrame([answer("etf", "likeSrtnCd", "005930", [{"itmsNm": "e"}]), answer("bond", "likeSrtnCd", "005930", {"itmsNm": "b"}), answer("stock", "likeSrtnCd", "005930", []), ("stock", "itmsNm", "A", "Unauthorized"), ("etn", "likeItmsNm", "A", None)], "kind string, parameter string, value string, payload string")
    found = providers.kr_resolve(providers.kr_candidates(asked), answers).collect()
    assert [(r.symbol, r.kind, r.parameter) for r in found] == [("005930", "etf", "likeSrtnCd")]


def test_xml_by_schema(spark):
    item = "<item n='1'><basDt>20240103</basDt><clpr unit='won'>5</clpr><itmsNm>A&amp;B</itmsNm></item>"
    wrap = lambda x: f"<?xml version='1.0'?>\n<response><header><resultCode>00</resultCode></header><body><items>{x}</items></body></response>"
    got = providers.kr_items(raw(spark, wrap(item), wrap(item.replace("A&amp;B", "<![CDATA[C <x>]]>") * 2), wrap(""), "<response><head")).collect()
    assert sorted((r.symbol, r.place, r.itmsNm, r.clpr) for r in got) == [("S0", 0, "A&B", "5"), ("S1", 0, "C <x>", "5"), ("S1", 1, "C <x>", "5")]


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        master = "spark://host:7077"
        conf = sparkContext = None

        def get(self, key, default):
            return default

        def getCheckpointDir(self):  # noqa: N802
            return None

    cluster = Cluster()
    cluster.conf = cluster.sparkContext = cluster
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(cluster)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_tickers(spark):
    df = spark.createDataFrame([('["A", "B"]',), ('{"a": 1}',), (None,)], "t string")
    assert [r[0] for r in df.select(providers.tickers(F.col("t"))).collect()] == [["A", "B"], None, None]


def test_monitor_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    bars = hourly_bars(events)
    cut = bars.selectExpr("timestamp_micros(cast(percentile(unix_micros(cast(bar_ts as timestamp)), 0.5) as bigint))").first()[0]
    for k, part in enumerate((bars.where(F.col("bar_ts") < F.lit(cut)), bars.where(F.col("bar_ts") >= F.lit(cut)))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sent = []
        stream = spark.readStream.schema(BARS).parquet(str(tmp_path / "in"))
        query = monitor_stream(stream, str(tmp_path / "state"), lambda df, n, sent=sent: sent.append({r.symbol: r.swing_probability for r in df.collect()}), alert=0.0, once=True)
        query.awaitTermination(120)
        assert len(sent) == 1, k
    want = {r.symbol: r.swing_probability for r in latest_analysis(bars).collect()}
    assert sent[0] == pytest.approx(want)


def test_stream_bars(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {(r.symbol, r.bar_ts): r.close for r in spark.table("hours").collect()}
    want = {(r.symbol, r.bar_ts): r.close for r in hourly_bars(events).collect()}
    assert got.items() <= want.items() and len(got) > 0.9 * len(want)


def test_indicators_of_a_stream_survive_restarts(spark, tmp_path):
    """Three batches, the stream started anew for each: together the indicators of the whole table."""
    bars = I.with_price(hourly_bars(spark.read.parquet(f"{DATA}/sf0.001/events.parquet"))).persist()
    times = sorted({r.bar_ts for r in bars.select("bar_ts").collect()})
    edges = [times[0], times[len(times) // 3], times[2 * len(times) // 3], dt.datetime(2100, 1, 1)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = bars.where((F.col("bar_ts") >= F.lit(a)) & (F.col("bar_ts") < F.lit(b)))
            late = bars.where(F.col("bar_ts") == F.lit(times[5])) if k == 2 else part.limit(0)
            part.unionByName(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = stream_recursive(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in")))
            query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    values = lambda df: {(r.symbol, r.bar_ts): [r[c] for c in COLUMNS] for r in df.collect()}
    got, want = values(spark.read.parquet(str(tmp_path / "out"))), values(recursive(bars))
    assert got.keys() == want.keys() and spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-12)) for k in want for x, y in zip(got[k], want[k], strict=True))
    bars.unpersist()


def test_lookups_are_not_broadcast_and_answers_parsed_once(spark):
    """Candidates and answers are exploded from a small table: by its size a planner would broadcast the one and parse answers twice."""
    from barwright.plans import catalog

    plan = catalog.kr_lookups(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "SortMergeJoin" in physical and "Broadcast" not in physical
    assert physical.count("Join") == 1


def test_parts_that_ask_for_one_symbol_get_their_own_answers(spark, tmp_path):
    """Keys of seven digits are cut to six, so parts 1,000,001, 1,000,005 and 1,000,009 all ask for 100000, with answers of different kinds."""
    from barwright.plans import catalog
    from tests.oracle import check, connect

    rows = [(1_000_001, "a", 3), (1_000_005, "b", 0), (1_000_009, "c", 7), (7, "d", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.kr_lookups(spark, str(tmp_path)).where("symbol = '100000'").count() == 3
    check(spark, connect(str(tmp_path), recursive=True), str(tmp_path), catalog.kr_lookups, catalog.oracle_sql()["kr_lookups"])
