"""Queue messages and payload envelopes: reading, unwrapping, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import text_or_empty
from logloom.schema import ENVELOPE, PAYLOAD

_MESSAGE_FILE = T.StructType([T.StructField("id", T.StringType()), T.StructField("body", T.StringType())])
_CORRUPT = "_corrupt_record"
_CHECKED_PAYLOAD = T.StructType([*PAYLOAD.fields, T.StructField(_CORRUPT, T.StringType())])


def read_messages(spark: SparkSession, path: str, stream: bool = True, max_files: int | None = None) -> DataFrame:
    """JSON-lines files of ``{"id", "body"}``; the body is an envelope object or a string holding one.

    ``max_files`` bounds one micro-batch of the stream (back-pressure); files wait in the folder meanwhile.
    """
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(_MESSAGE_FILE).json(path).select(F.col("id").alias("message_id"), F.col("body").alias("raw"))


def read_envelopes(spark: SparkSession, path: str, stream: bool = True, max_files: int | None = None) -> DataFrame:
    """JSON-lines files that hold the envelope fields themselves, with the decoded body added."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return decode_body(reader.schema(ENVELOPE).json(path).withColumn("raw", F.lit(None).cast("string"))
                       .withColumn("reason", F.lit(None).cast("string")))


def unwrap(messages: DataFrame) -> DataFrame:
    """``(message_id, raw)`` to payload columns; ``reason`` is set where the text is no envelope.

    A message without an id is identified by the digest of its text.
    """
    quoted = F.from_json(F.concat(F.lit('{"v":'), F.col("raw"), F.lit("}")), "v string")["v"]
    inner = F.when(F.col("raw").startswith('"'), F.coalesce(quoted, F.col("raw"))).otherwise(F.col("raw"))
    payload = F.from_json(inner, _CHECKED_PAYLOAD, {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = messages.select(
        F.coalesce("message_id", F.md5("raw")).alias("message_id"), "raw", payload.alias("p"))
    bad = F.col("p").isNull() | F.col(f"p.{_CORRUPT}").isNotNull()
    return decode_body(parsed.select(
        "message_id", "raw", *[F.col(f"p.{name}").alias(name) for name in PAYLOAD.fieldNames()],
        F.when(bad, F.lit("bad message")).alias("reason")))


def decode_body(envelopes: DataFrame) -> DataFrame:
    """Base64 ``body`` to text; ``reason`` is set where it is not Base64."""
    data = F.try_to_binary(text_or_empty(F.col("body")), F.lit("base64"))
    return (envelopes
            .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
                        .when(data.isNull(), F.lit("bad base64")))
            .withColumn("body", F.make_valid_utf8(data.cast("string")))
            .withColumn("source", text_or_empty(F.col("source")))
            .withColumn("format", text_or_empty(F.col("format"))))


def event_id(message_id: Column, position: Column) -> Column:
    """A UUID-shaped id that depends only on the message and the record's place in it.

    Unlike ``uuid()`` it survives task retries and batch replays unchanged.
    """
    digest = F.md5(F.concat_ws("#", message_id, position.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
