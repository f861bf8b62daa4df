"""History files: one CSV or Parquet file per symbol, loaded as one table of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.exprs import safe_file_name
from barwright.operators.bars import PRICES, coerce, dedup, normal_name, stack

SUFFIXES = r"(_historical\.(csv|parquet|xlsx)|\.(csv|parquet|xlsx)|\.[^.]*)$"
OPTIONAL = ("dividends", "stock_splits")


def file_symbol(name: Column) -> Column:
    """A file's name without its first matching suffix."""
    return F.regexp_replace(name, SUFFIXES, "")


def _fields(line: Column) -> Column:
    """The fields of a CSV line as an array; a quoted one may have commas, and doubled quotes for its own."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), '""', '"'))
    quoted = F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), plain)
    return F.when(line.contains('"'), quoted).otherwise(F.transform(F.split(line, ","), lambda x: F.trim(x)))


def _csv_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lines, files) of a folder's CSV files: every line but the first with its file, and each file with its header and why it can't be used.

    Spark reads the lines, large files in several parts. A file's header is its first line; one row a file is all that is aggregated, and the
    driver opens none.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"), F.monotonically_increasing_id().alias("_line"))
    first = lines.where("block = 0").groupBy("path", "file").agg(F.min(F.struct("_line", "value")).alias("f"))
    files = first.select("path", "file", "f._line", "f.value")
    raw = _fields(F.regexp_replace("value", "^\ufeff", ""))
    names = F.transform(raw, lambda h: F.when(h == "Date", "date").otherwise(F.replace(F.lower(h), F.lit(" "), F.lit("_"))))
    files = files.select("path", "file", F.col("_line").alias("_header"), names.alias("names"), F.exists(raw, lambda h: h == "Date").alias("dated"))
    missing = F.filter(F.array(*map(F.lit, PRICES)), lambda c: ~F.array_contains("names", c))
    why = F.when(~F.col("dated"), "no Date column").when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
    return lines, files.withColumn("reason", why)


def _csv_bars(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Bars of the usable files: each line's fields by the names of its file's header. One row a file is joined to the lines."""
    known = files.where("reason is null").select("path", "_header", "names")
    rows = lines.join(known, "path").where(F.col("_line") != F.col("_header")).withColumn("fields", _fields(F.col("value")))
    value = lambda c: F.try_element_at("fields", F.nullif(F.array_position("names", c).cast("int"), F.lit(0)))
    at = value("date").try_cast("timestamp").cast("timestamp_ntz")
    number = lambda c: value(c).try_cast("double")
    has = F.array_contains("names", "adj_close")
    rows = rows.select(file_symbol(F.col("file")).alias("symbol"), at.alias("bar_ts"), *(value(c).alias(c) for c in PRICES), F.when(has, number("adj_close")).alias("_adjusted"), has.alias("_has"), *(number(c).alias(c) for c in OPTIONAL), "_line")
    rows = coerce(rows.where("bar_ts is not null"))
    return rows.select("symbol", "bar_ts", *PRICES, F.when(F.col("_has"), F.col("_adjusted")).otherwise(F.col("close")).alias("adj_close"), *OPTIONAL, "_line")


def _clean(df: DataFrame, date: str) -> DataFrame:
    """Raw columns of Parquet files to bars: times read (bad ones dropped), numbers coerced, first row of each time kept."""
    df = df.toDF(*("date" if c == date else normal_name(c) for c in df.columns))
    if missing := [c for c in PRICES if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    at = F.col("date").try_cast("timestamp").cast("timestamp_ntz")
    df = coerce(df.withColumn("bar_ts", at).where("bar_ts is not null"))
    number = lambda c: F.col(c).try_cast("double")
    adjusted = number("adj_close") if "adj_close" in df.columns else F.col("close")
    extra = [number(c).alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in OPTIONAL]
    return df.select("symbol", "bar_ts", *PRICES, adjusted.alias("adj_close"), *extra, "_line")


def load_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(bars of all files, rejected files as rows of file and reason). Any number of files, of any headers, is one read.

    CSV headers are matched after trimming, lower-casing and underscores; `Date` must be there. A field doesn't go over lines; Spark doesn't see files
    without a byte. Of rows with the same time in a file the first in the file stays. An error is raised if no file can be used.
    """
    lines, files = _csv_files(spark, folder)
    parts, rejects = [_csv_bars(lines, files)], files.where("reason is not null").select("file", "reason")
    usable = not files.where("reason is null").isEmpty()
    if parquet := _parquet(spark, folder):
        raw = parquet.withColumn("symbol", file_symbol(F.col("_metadata.file_name"))).withColumn("_line", F.monotonically_increasing_id())
        try:
            if (date := next((c for c in raw.columns if c.lower() in ("date", "bar_ts")), None)) is None:
                raise ValueError("no Date column")
            parts.append(_clean(raw, date))
            usable = True
        except ValueError as e:
            rejects = rejects.unionByName(parquet.select(F.col("_metadata.file_name").alias("file")).distinct().withColumn("reason", F.lit(str(e))))
    if not usable:
        raise ValueError(f"no usable history in {folder}: {[tuple(r) for r in rejects.limit(20).collect()]}")
    return dedup(stack(parts), ["symbol", "bar_ts"], [F.col("_line")]).drop("_line"), rejects


def _parquet(spark: SparkSession, folder: str) -> DataFrame | None:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    if files.isEmpty():
        return None
    return spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def write_history(bars: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Bars by symbol, in folders named for the symbol made safe as a file name."""
    named = bars.withColumn("file", safe_file_name(F.col("symbol")))
    named.repartition("file").sortWithinPartitions("file", "bar_ts").write.mode("overwrite").partitionBy("file").format(kind).options(header="true").save(folder)
