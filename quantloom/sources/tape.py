"""Trade tapes and bar tables: schemas, scans, sinks, and what cleans them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

TRADES = "sip_timestamp long, price double, size double"
SECONDS = "t long, o double, h double, l double, c double, v double"


def micros(ts: str = "ts") -> F.Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def read_trades(spark: SparkSession, path: str, symbol: str = "", limit: int | None = None) -> DataFrame:
    """A tape of CSV files as (symbol, seq, ts_ns, ts, ts_us, price, size), what bars are made of; ``limit`` caps rows in time order."""
    df = spark.read.schema(TRADES).csv(path, header=True).withColumn("file_row", F.monotonically_increasing_id())
    df = df.select(
        F.lit(symbol).alias("symbol"), F.col("file_row").alias("seq"), F.col("sip_timestamp").alias("ts_ns"),
        F.expr("timestamp_micros(sip_timestamp div 1000)").cast("timestamp_ntz").alias("ts"), F.expr("sip_timestamp div 1000").alias("ts_us"), "price", "size",
    )
    return df if limit is None else df.orderBy("ts_ns", "seq").limit(limit)


def read_seconds(spark: SparkSession, path: str, symbol: str = "") -> DataFrame:
    """Second aggregates (t in ms) as (symbol, seq, ts_ms, ts, open, high, low, price, volume)."""
    df = spark.read.schema(SECONDS).csv(path, header=True)
    return df.select(
        F.lit(symbol).alias("symbol"), F.col("t").alias("seq"), F.col("t").alias("ts_ms"), F.expr("timestamp_millis(t)").cast("timestamp_ntz").alias("ts"),
        F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("price"), F.col("v").alias("volume"),
    )


def write_bars(bars: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append a result table."""
    bars.write.mode("append").option("header", True).format(fmt).save(path)


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick tape of the ``events`` table."""
    events = ship(spark).read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), "ts", F.round(F.col("value") * 100).cast("long").alias("price_c"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
    )


def price_walk(ticks: DataFrame) -> DataFrame:
    """A price path from a tape: 100 * exp(1e-6 * running sum of price_c - 5000), by symbol."""
    run = F.sum(F.col("price_c") - 5000).over(W.partitionBy("symbol").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return ticks.select("symbol", "seq", "ts", micros().alias("ts_us"), "size", F.round(100 * F.exp(F.lit(1e-6) * run), 4).alias("price"))


def unique_times(df: DataFrame) -> DataFrame:
    """The n-th row of one symbol and time is moved by n-1 milliseconds."""
    n = F.row_number().over(W.partitionBy("symbol", "ts").orderBy("seq"))
    return df.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, cast(0.001 * (n - 1) as decimal(18, 6)))")) if "n" in df.columns else df.withColumn("n", n).withColumn(
        "ts", F.expr("ts + make_dt_interval(0, 0, 0, cast(0.001 * (n - 1) as decimal(18, 6)))")
    ).drop("n")


def second_of_day(ts: str = "ts", zone: str = "America/New_York") -> F.Column:
    """Seconds since local midnight of a UTC time without zone."""
    return F.expr(f"(unix_micros(cast(date_format(convert_timezone('UTC', '{zone}', {ts}), \"yyyy-MM-dd HH:mm:ss.SSSSSS\") || ' UTC' as timestamp)) % 86400000000) / 1000000D")


def in_session(ts: str = "ts", inclusive: bool = True) -> F.Column:
    """9:30 to 16:00 in New York, both ends in or both out."""
    s = second_of_day(ts)
    return (s >= 34200) & (s <= 57600) if inclusive else (s > 34200) & (s < 57600)


def synthetic_features(spark: SparkSession, n: int = 10_000, informative: int = 10, redundant: int = 10, noise: int = 20, seed: int = 0) -> DataFrame:
    """A two-class problem; I_ columns carry the label, R_ are mixes of them, N_ are noise; weight 1/n."""
    df = spark.range(n).withColumn("bin", (F.rand(seed) < 0.5).cast("int"))
    df = df.withColumns({f"I_{i}": F.randn(seed + 1 + i) + (2 * F.col("bin") - 1) * (0.3 + 0.7 * ((i * 7) % 10) / 10) for i in range(informative)})
    df = df.withColumns({f"R_{i}": sum((F.col(f"I_{(i + j) % informative}") * (1.0 / (j + 1)) for j in range(min(3, informative))), F.lit(0.0)) for i in range(redundant)})
    df = df.withColumns({f"N_{i}": F.randn(seed + 1000 + i) for i in range(noise)})
    return df.withColumn("w", F.lit(1.0 / n)).withColumn("t0", F.col("id"))
