"""Raw text lines from files or from a Kafka topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import without_cr
from tidemark.schemas import TEXT_LINE

# Where lines are read from when nothing else is said.
DEFAULT_TOPIC = "defaultTopic"
DEFAULT_SERVERS = "localhost:9092"
DEFAULT_GROUP = "defaultGroupID"


def text_lines(
    spark: SparkSession,
    path: str,
    delimiter: str = "\n",
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """One row per line (column ``value``), without a carriage return at its end, whatever the delimiter.

    As a stream, ``path`` is a folder new files land in. One of the two limits
    keeps a micro-batch small when a backlog is read.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("lineSep", delimiter)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if streaming and max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    lines = reader.schema(TEXT_LINE).format("text").load(path)
    return lines.select(without_cr(F.col("value")).alias("value"))


def kafka_options(
    topic: str = DEFAULT_TOPIC,
    servers: str = DEFAULT_SERVERS,
    group: str = DEFAULT_GROUP,
    max_offsets_per_trigger: int | None = None,
    starting_offsets: str | None = None,
    fail_on_data_loss: bool = True,
) -> dict[str, str]:
    """Options of Spark's Kafka reader. ``starting_offsets`` is ``earliest``, ``latest`` or Kafka's JSON of offsets."""
    options = {
        "failOnDataLoss": str(fail_on_data_loss).lower(),
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.group.id": group,
    }
    if starting_offsets:
        options["startingOffsets"] = starting_offsets
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_lines(
    spark: SparkSession,
    topic: str = DEFAULT_TOPIC,
    servers: str = DEFAULT_SERVERS,
    group: str = DEFAULT_GROUP,
    streaming: bool = True,
    max_offsets_per_trigger: int | None = None,
    starting_offsets: str | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """UTF-8 messages of a topic as lines; needs Spark's Kafka package on the classpath."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    limit = max_offsets_per_trigger if streaming else None
    options = kafka_options(topic, servers, group, limit, starting_offsets, fail_on_data_loss)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))
