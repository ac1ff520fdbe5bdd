"""Priority topics: message encoding, sinks, and sources for the three consumers.

The format is an option. Parquet folders partitioned by topic are the tested form; with format="kafka" the same
frames go to and come from a broker, keyed by source so that one machine's events keep their order.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fablens import constants as C

MESSAGE_SCHEMA = "key STRING, value STRING, topic STRING"
CONSUMER_TOPICS = {
    "hot": [C.TOPIC_P0, C.TOPIC_P1],
    "cold": [C.TOPIC_P2],
    "deadletter": [C.TOPIC_DEADLETTER],
}
EVENT_SCHEMA = (
    "job_id STRING, event_index LONG, timestamp STRING, source STRING, event_type STRING, severity STRING, "
    "message STRING, ai_normalized STRUCT<category: STRING, root_cause: STRING, recommended_action: STRING, "
    "confidence: DOUBLE>, novelty_score DOUBLE"
)


def encode_messages(events: DataFrame, topic: str = "topic", key: str = "source") -> DataFrame:
    """key, JSON value and topic for each event that has a topic."""
    payload = [c for c in events.columns if c != topic]
    return events.filter(F.col(topic).isNotNull()).select(
        F.col(key).alias("key"), F.to_json(F.struct(*payload)).alias("value"), F.col(topic).alias("topic")
    )


def write_messages(messages: DataFrame, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None):
    """Write a batch of messages; gzip-compressed as on the topics."""
    if fmt == "kafka":
        messages.write.format("kafka").option("kafka.compression.type", "gzip").options(**(options or {})).save()
    else:
        messages.write.mode("overwrite").partitionBy("topic").option("compression", "gzip").format(fmt).save(path)


def read_topics(
    spark: SparkSession,
    path: str,
    topics: Sequence[str],
    streaming: bool = True,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Messages of some topics from the earliest on; the topic filter prunes folders."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        return (
            reader.format("kafka").option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
            .options(**(options or {})).load().select(F.col("key").cast("string"), "value", "topic")
        )
    frame = reader.schema(MESSAGE_SCHEMA).options(**(options or {})).format(fmt).load(path)
    return frame.filter(F.col("topic").isin(list(topics)))


def _gunzip(data: bytes) -> str | None:
    try:
        return gzip.decompress(data).decode("utf-8")
    except (OSError, EOFError, zlib.error, UnicodeDecodeError):
        return None


@F.pandas_udf(StringType())
def _gunzip_udf(values: pd.Series) -> pd.Series:
    return values.map(_gunzip, na_action="ignore")


def decode_messages(
    messages: DataFrame, schema: str = EVENT_SCHEMA, value: str = "value", maybe_gzip: bool = False
) -> DataFrame:
    """Events from message values; a value that cannot be read is skipped.

    With `maybe_gzip` the value is binary and may be gzipped; only then Python is used, on the gzipped values.
    """
    text: Column = F.col(value).cast("string")
    if maybe_gzip:
        zipped = F.substring(F.col(value), 1, 2) == F.unhex(F.lit("1F8B"))
        text = F.coalesce(_gunzip_udf(F.when(zipped, F.col(value))), F.when(~zipped, F.col(value).cast("string")))
    event = F.from_json(text, f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in messages.columns if c != value]
    decoded = messages.withColumn("_event", event)
    kept = decoded.filter(F.col("_event").isNotNull() & F.col("_event._corrupt").isNull())
    return kept.select(*rest, "_event.*").drop("_corrupt")
