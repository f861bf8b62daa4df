"""Parsers for the price services' payloads, as column expressions over rows of raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed names of the services' formats: series, fields and codes.
US_SERIES = ("Time Series (Daily)", "Time Series (60min)", "Time Series (5min)", "Weekly Adjusted Time Series", "Monthly Adjusted Time Series")
US_FIELDS = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
KR_FIELDS = ("basDt", "clpr", "mkp", "hipr", "lopr", "trqu", "srtnCd", "isinCd", "itmsNm")
KR_AUTH_CODES = ("20", "30", "31", "32")
KR_ITEM = "struct<" + ",".join(f"{f}:string" for f in KR_FIELDS) + ">"
# Fixed names that users write before a Korean symbol, the asset kinds they stand for, and the order in which kinds are asked.
ASSET_ORDER = ("stock", "etf", "etn", "elw", "security", "warrant_security", "warrant_certificate", "bond")
ASSET_ALIASES = {
    "stock": "stock", "stocks": "stock", "equity": "stock", "equities": "stock", "security": "security", "securities": "security", "beneficiary": "security", "fund": "security", "funds": "security",
    "etf": "etf", "etn": "etn", "elw": "elw", "bond": "bond", "bonds": "bond", "future": "future", "futures": "future", "option": "option", "options": "option",
    "warrant": "warrant_security", "warrants": "warrant_security", "certificate": "warrant_certificate",
}


def us_status(payload: Column) -> Column:
    """ok, error, rate_limited, premium (ask for the compact size) or empty."""
    has = lambda k: F.get_json_object(payload, f"$['{k}']").isNotNull()
    notice = F.get_json_object(payload, "$['Information']")
    return F.when(has("Error Message"), "error").when(F.lower(notice).contains("premium"), "premium").when(has("Note") | notice.isNotNull(), "rate_limited").when(F.coalesce(*(F.get_json_object(payload, f"$['{k}']") for k in (*US_SERIES, "data"))).isNull(), "empty").otherwise("ok")


def us_daily(raw: DataFrame) -> DataFrame:
    """Bars from (symbol, payload): the first series that is there, a row per time, plain names or 0 for absent fields."""
    series = F.coalesce(*(F.get_json_object("payload", f"$['{k}']") for k in US_SERIES))
    each = raw.select("symbol", F.explode(F.from_json(series, "map<string,map<string,string>>")).alias("t", "v"))
    value = lambda name, key: F.coalesce(F.col("v")[key], F.col("v")[name], F.lit("0")).try_cast("double").alias(name)
    out = each.select("symbol", F.col("t").try_cast("timestamp_ntz").alias("bar_ts"), *(value(n, k) for n, k in US_FIELDS.items()))
    return out.withColumn("adj_close", F.col("close"))


def us_commodity(raw: DataFrame) -> DataFrame:
    """Bars of one value each from (symbol, payload); rows whose value or date can't be read go."""
    each = raw.select("symbol", F.explode(F.from_json(F.get_json_object("payload", "$.data"), "array<struct<date:string,value:string>>")).alias("d"))
    v = F.col("d.value").try_cast("double")
    out = each.select("symbol", F.col("d.date").try_cast("timestamp_ntz").alias("bar_ts"), *(v.alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"), v.alias("adj_close"))
    return out.dropna(subset=["bar_ts", "close"])


KR_XML = f"header struct<resultCode:string>, body struct<items:struct<item:array<{KR_ITEM}>>>"


def _xml(payload: Column) -> Column:
    """An XML payload by its schema: entities, CDATA, attributes and comments as XML has them; null for any other text."""
    return F.from_xml(F.when(F.ltrim(payload).startswith("<"), F.trim(payload)), KR_XML, {"mode": "PERMISSIVE"})


def kr_status(payload: Column) -> Column:
    """ok, empty, auth (keys and limits) or error, for JSON and XML alike."""
    code = F.coalesce(F.get_json_object(payload, "$.response.header.resultCode"), F.trim(_xml(payload)["header"]["resultCode"]))
    return F.when(F.coalesce(F.trim(payload), F.lit("")) == "", "empty").when(code.isin(*KR_AUTH_CODES) | (code.isNull() & F.lower(payload).contains("unauthorized")), "auth").when(code == "00", "ok").otherwise("error")


def kr_items(raw: DataFrame, *carried: str) -> DataFrame:
    """(symbol, carried columns, place, item fields) from (symbol, payload) with JSON (one item or a list) or XML items."""
    item = F.get_json_object("payload", "$.response.body.items.item")
    from_json = F.when(F.trim(item).startswith("["), F.from_json(item, f"array<{KR_ITEM}>")).otherwise(F.array(F.from_json(item, KR_ITEM)))
    text = lambda x, f: F.nullif(F.trim(x[f]), F.lit("")).alias(f)
    from_xml = F.transform(_xml(F.col("payload"))["body"]["items"]["item"], lambda x: F.struct(*(text(x, f) for f in KR_FIELDS)))
    items = F.when(F.ltrim("payload").startswith("<"), from_xml).when(item.isNotNull(), from_json)
    return raw.where(kr_status(F.col("payload")) == "ok").select("symbol", *carried, F.posexplode(items).alias("place", "item")).select("symbol", *carried, "place", "item.*")


def kr_lookup(symbol: Column) -> Column:
    """What a Korean symbol asks for: (kind, value), the kind null where no known name stands before a colon."""
    text = F.trim(F.coalesce(symbol, F.lit("")))
    name, rest = F.lower(F.regexp_extract(text, r"(?s)^([A-Za-z]+):(.+)$", 1)), F.trim(F.regexp_extract(text, r"(?s)^([A-Za-z]+):(.+)$", 2))
    kind = F.when(rest != "", F.create_map(*(F.lit(x) for kv in ASSET_ALIASES.items() for x in kv))[name])
    return F.named_struct(F.lit("kind"), kind, F.lit("value"), F.when(kind.isNotNull(), rest).otherwise(text))


def _by_code(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def _by_isin(value: Column) -> Column:
    return value.startswith("KR") & (F.length(value) >= 10)


def kr_candidates(asked: DataFrame, as_of: Column | None = None, months: int = 14, carried: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, symbol, place, kind, parameter, value) of every request to try for each symbol, in order; with `as_of`, also the days to ask for.

    Kinds come in their order, and for each the parameters: a code, an ISIN or a name, the latter two exactly, then in part. A symbol
    of a kind that can't be asked has no candidates.
    """
    look = asked.select(*carried, "symbol", kr_lookup(F.col("symbol")).alias("look")).distinct()
    value, order = F.col("look.value"), F.array(*map(F.lit, ASSET_ORDER))
    kinds = F.when(F.col("look.kind").isNull(), order).otherwise(F.filter(order, lambda k: k == F.col("look.kind")))
    names = lambda *n: F.array(*map(F.lit, n))
    parameters = F.when(_by_isin(value), names("isinCd", "likeIsinCd")).when(_by_code(value), names("likeSrtnCd")).otherwise(names("itmsNm", "likeItmsNm"))
    out = look.select(*carried, "symbol", value.alias("value"), F.posexplode(kinds).alias("k", "kind"), parameters.alias("parameters")).select(*carried, "symbol", "value", "k", "kind", F.posexplode("parameters").alias("p", "parameter"))
    days = [] if as_of is None else [F.date_format(F.add_months(as_of, -months), "yyyyMMdd").alias("begin_day"), F.date_format(as_of, "yyyyMMdd").alias("end_day")]
    return out.select(*carried, "symbol", (2 * F.col("k") + F.col("p")).alias("place"), "kind", "parameter", "value", *days)


def kr_resolve(candidates: DataFrame, answers: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, symbol, kind, parameter, payload): for every symbol the first candidate whose answer (kind, parameter, value, payload) has items.

    Where both have `carried` columns, such as an asker's key, a symbol's answers are its own asker's, whoever else asks for it.

    One join and one partial aggregation for all symbols; symbols without such an answer have no row. An answer is parsed once, and
    the join is by sorting: candidates and answers are many times what a planner takes them for before they are exploded, so neither may be broadcast.
    """
    item = F.get_json_object("payload", "$.response.body.items.item")
    of_json = (kr_status(F.col("payload")) == "ok") & item.isNotNull() & ~F.trim(item).isin("", "[]", "{}")
    of_xml = F.exists(F.array(_xml(F.col("payload"))), lambda x: (F.trim(x["header"]["resultCode"]) == "00") & (F.size(x["body"]["items"]["item"]) > 0))
    good = answers.where(F.when(F.ltrim("payload").startswith("<"), of_xml).otherwise(of_json)).select(*carried, "kind", "parameter", "value", "payload")
    first = candidates.join(good.hint("merge"), [*carried, "kind", "parameter", "value"]).groupBy(*carried, "symbol").agg(F.min_by(F.struct("kind", "parameter", "payload"), F.struct("place", "payload")).alias("first"))
    return first.select(*carried, "symbol", "first.*")


def kr_select(items: DataFrame) -> DataFrame:
    """A lookup's items: those that match its code or name if any do, of a name the identity with most rows.

    Ties go to the identity seen first. What a symbol's items come to is one row of partial aggregates, which is joined back, so no task
    sorts or holds a lookup's items.
    """
    look = kr_lookup(F.col("symbol"))["value"]
    exact = F.when(_by_code(look), F.trim("srtnCd") == look).when(_by_isin(look), F.trim("isinCd") == look).otherwise(F.trim("itmsNm") == look)
    identity = F.trim(F.coalesce(F.nullif("srtnCd", F.lit("")), F.nullif("isinCd", F.lit("")), F.nullif("itmsNm", F.lit("")), F.lit("")))
    marked = items.withColumns({"_exact": F.coalesce(exact, F.lit(False)), "_by_name": ~(_by_code(look) | _by_isin(look)), "_identity": identity})
    groups = marked.groupBy("symbol", "_exact", "_identity").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = groups.groupBy("symbol").agg(F.max("_exact").alias("_any"), F.max_by("_identity", F.struct("_exact", "n", -F.col("first"))).alias("_best"))
    kept = marked.join(best, "symbol").where((F.col("_exact") | ~F.col("_any")) & (~F.col("_by_name") | (F.col("_identity") == F.col("_best"))))
    return kept.drop("_exact", "_by_name", "_identity", "_any", "_best")


def kr_bars(items: DataFrame) -> DataFrame:
    """Bars from items: commas dropped, missing open, high, low take the close, volume 0; the last of a day stays."""
    number = lambda f: F.regexp_replace(f, ",", "").try_cast("double")
    optional = {"open": "mkp", "high": "hipr", "low": "lopr", "volume": "trqu"}
    has = {c: f in items.columns for c, f in optional.items()}
    there = items.groupBy("symbol").agg(*((F.count(f) > 0 if has[c] else F.lit(False)).alias(f"_{c}") for c, f in optional.items()))
    close = number("clpr")
    value = lambda c: F.when(F.col(f"_{c}"), number(optional[c]) if has[c] else F.lit(None).cast("double")).otherwise(F.lit(0.0) if c == "volume" else close).alias(c)
    out = items.join(there, "symbol").select("symbol", "place", F.try_to_timestamp("basDt", F.lit("yyyyMMdd")).cast("timestamp_ntz").alias("bar_ts"), value("open"), value("high"), value("low"), close.alias("close"), value("volume"))
    out = out.dropna(subset=["bar_ts", "close"])
    last = F.row_number().over(Window.partitionBy("symbol", "bar_ts").orderBy(F.desc("place")))
    return out.withColumn("_last", last).where("_last = 1").drop("_last", "place").withColumn("adj_close", F.col("close"))


def tickers(payload: Column) -> Column:
    """A JSON array of strings as an array; null if it is anything else."""
    return F.when(F.trim(payload).startswith("["), F.from_json(payload, "array<string>"))
