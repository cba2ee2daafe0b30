"""Sensor readings, batch or stream: one-minute medians against permissible
ranges. Late readings count until the watermark passes their minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.rdf.vocabulary import RANGES


def parse_payload(raw: DataFrame, column: str = "payload", properties: tuple[str, ...] = tuple(RANGES)) -> DataFrame:
    """(station, ts, property, value) of JSON payloads with a value for each
    property; unreadable payloads and absent values give no row."""
    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(p, T.DoubleType()) for p in properties]])
    parsed = raw.select(F.from_json(column, schema).alias("r")).select("r.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in properties]))
    return parsed.select("station", "ts", pairs.alias("m")).select("station", "ts", "m.property", "m.value").filter("station IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")


def permissible(spark: SparkSession, ranges: dict = RANGES) -> DataFrame:
    return spark.createDataFrame([(p, low, high) for p, (low, high) in ranges.items()], "property string, low double, high double")


def medians(readings: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """(station, property, start, median, n) of tumbling windows."""
    source = readings.withWatermark("ts", watermark) if watermark else readings
    return source.groupBy("station", "property", F.window("ts", width).alias("w")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("n")).select("station", "property", F.col("w.start").alias("start"), "median", "n")


def breaches(figures: DataFrame, ranges: DataFrame) -> DataFrame:
    """The windows whose median is out of its property's range; ranges is a row
    for each property."""
    joined = figures.join(F.broadcast(ranges), "property")
    return joined.filter((F.col("median") < F.col("low")) | (F.col("median") > F.col("high"))).select("station", "property", "start", "median", "n", F.when(F.col("median") < F.col("low"), "low").otherwise("high").alias("side"))
