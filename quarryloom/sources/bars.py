"""Daily bars and side tables, derived from the star-schema tables; readers of landed bars and lists of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scratch import shared

BAR_COLUMNS = ["symbol", "bar_date", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(value: Column) -> Column:
    """Rounded to 1e-4 in a way that every engine agrees on."""
    return F.floor(value * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def _bars(facts: DataFrame) -> DataFrame:
    """facts: symbol, bar_date, sd, st, q, n (sums of discounts, taxes and quantities of a day, and rows)."""
    returns = facts.withColumn("ret", F.round((F.col("sd") - 5 * F.col("n")) / F.sqrt(F.col("n").cast("double")) * F.lit(160.0)).cast("long"))
    day = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    walked = returns.withColumn("cum", F.sum("ret").over(day))
    priced = walked.select(
        "symbol", "bar_date", _cents(F.lit(50.0) * F.exp((F.col("cum") - F.col("ret")) / F.lit(1e4))).alias("open"), _cents(F.lit(50.0) * F.exp(F.col("cum") / F.lit(1e4))).alias("close"),
        (F.col("st").cast("double") / F.col("n")).alias("tx"), (F.col("q") * 20000).cast("long").alias("volume"),
    )
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return priced.select("symbol", "bar_date", "open", _cents(top * (1 + F.col("tx") / F.lit(200.0))).alias("high"), _cents(bottom * (1 - F.col("tx") / F.lit(200.0))).alias("low"), "close", "volume")


def _facts(rows: DataFrame) -> DataFrame:
    whole = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return rows.groupBy("symbol", "bar_date").agg(whole("l_discount").alias("sd"), whole("l_tax").alias("st"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))


@shared
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each brand and ship date."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("bar_date"), "l_discount", "l_tax", "l_quantity")
    return _bars(_facts(lines.join(part, lines["l_partkey"] == part["p_partkey"])))


@shared
def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three index series: MAIN over all lines, and two slices by return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("bar_date"), "l_discount", "l_tax", "l_quantity")
    named = F.explode(F.array(F.lit("MAIN"), F.when(F.col("l_returnflag") == "N", "WIDE").when(F.col("l_returnflag") == "R", "SMALL")))
    return _bars(_facts(lines.withColumn("symbol", named).where("symbol is not null")))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, earnings_date): the first order date of each quarter of the brand that the order's key points to."""
    symbols = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).alias("k")).agg(F.min("p_brand").alias("symbol"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 25).alias("k"), F.to_date("o_orderdate").alias("d"))
    return orders.join(symbols, "k").groupBy("symbol", F.trunc("d", "quarter").alias("q")).agg(F.min("d").alias("earnings_date")).select("symbol", "earnings_date")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, n_analysts): suppliers by nation stand for analysts of a brand."""
    symbols = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    order = F.row_number().over(Window.orderBy("symbol")) - 1  # a row for each symbol
    counts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_analysts"))
    return symbols.withColumn("s_nationkey", order).join(counts, "s_nationkey", "left").select("symbol", F.col("n_analysts").cast("long"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector): a brand's most frequent type."""
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    best = F.max_by("p_type", F.struct("n", "p_type"))
    return counted.groupBy(F.col("p_brand").alias("symbol")).agg(best.alias("sector"))


def landed_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars landed as Parquet by scan date; of each symbol and day the latest snapshot wins."""
    rows = spark.read.parquet(path)
    return rows.groupBy("symbol", "bar_date").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "scan_date").alias("b")).select("symbol", "bar_date", "b.*")


def candles(raw: DataFrame) -> DataFrame:
    """raw: symbol and a JSON payload with epoch-millisecond candles."""
    kind = "struct<candles:array<struct<datetime:bigint,open:double,high:double,low:double,close:double,volume:bigint>>>"
    rows = raw.select("symbol", F.explode(F.from_json("payload", kind)["candles"]).alias("c"))
    return rows.select("symbol", F.to_date(F.timestamp_millis("c.datetime")).alias("bar_date"), "c.open", "c.high", "c.low", "c.close", "c.volume")


def watchlist(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """Distinct symbols of exported lists: the first column, after the header lines of each file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    symbol = F.trim(F.split("line", ",")[0])
    return lines.where((F.col("at") >= skip) & symbol.rlike("^[A-Za-z0-9-]+$")).select(symbol.alias("symbol")).distinct()


def listed_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a pipe-delimited exchange listing without tests and funds."""
    rows = spark.read.csv(path, sep="|", header=True)
    return rows.where(F.col("Symbol").rlike("^[A-Z]{1,5}$") & (F.col("Test Issue") == "N") & (F.col("ETF") == "N")).select(F.col("Symbol").alias("symbol")).distinct().orderBy("symbol")
