"""Messages of the speech and answer services, and the settings document: schemas, readers, fields, routing.

All parsing goes by fixed schemas; a message that doesn't fit counts as one without the field."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, jstext, labels, settings
from ..functions.prompt import DEFAULT_TEMPLATE, DEFAULT_TOPIC

SPEECH = "type STRING, channel STRUCT<alternatives: ARRAY<STRUCT<transcript: STRING>>>, is_final BOOLEAN"
ANSWER = "choices ARRAY<STRUCT<delta: STRUCT<content: STRING>>>"
EVENT_LOG = "session STRING, seq BIGINT, kind STRING, text STRING, ts_ms BIGINT"
#: Kinds of the event log.
KINDS = ["interim", "final", "chunk", "done", "clear", "status", "start", "stop", "failed", "keys", "error", "audio"]
STORED = "topic STRING, topicPromptTemplate STRING, overlay STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE, opacity: DOUBLE>, deepgramApiKey STRING, openAiApiKey STRING"


def speech(rows: DataFrame, message: str = "message") -> DataFrame:
    """Transcripts of messages: adds `text` and `is_final`. Only results with words stay, of each the first alternative."""
    got = rows.withColumn("_m", F.from_json(F.col(message), SPEECH))
    text = F.coalesce(jstext.trim(F.get(F.col("_m.channel.alternatives"), F.lit(0))["transcript"]), F.lit(""))
    got = got.withColumn("_text", F.when(F.col("_m.type") == "Results", text))
    kept = got.where("_text <> ''").drop("text", "is_final")
    return kept.withColumn("is_final", F.coalesce(F.col("_m.is_final"), F.lit(False))).withColumnRenamed("_text", "text").drop("_m")


def route(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final and interim transcripts."""
    return transcripts.where("is_final"), transcripts.where("not is_final")


def token(message: Column) -> Column:
    """The piece of text in a message of the answer service, as it is; empty where there is none."""
    return F.coalesce(F.get(F.from_json(message, ANSWER)["choices"], F.lit(0))["delta"]["content"], F.lit(""))


def tokens(rows: DataFrame, message: str = "message") -> DataFrame:
    """Adds `text`, the piece of text of each message; messages without are dropped."""
    return rows.withColumn("text", token(F.col(message))).where("text <> ''")


def sound(rows: DataFrame, data: str = "data") -> DataFrame:
    """Adds `samples` of chunks of bytes; null and empty chunks are dropped."""
    return rows.withColumn("samples", audio.from_bytes(F.col(data))).where("samples is not null")


def blocks(rows: DataFrame, channels: str = "channels", rate: int = audio.INPUT_RATE) -> DataFrame:
    """Adds `pcm`, the first channel of each block at the output rate; blocks without one, or without samples, are dropped."""
    return rows.withColumn("pcm", audio.capture(audio.channel(F.col(channels)), rate)).where(F.size("pcm") > 0)


def with_audio_track(tracks: DataFrame) -> DataFrame:
    """The audio tracks of sources (source, track, ...): others are dropped, and a source without one is an error."""
    counts = tracks.groupBy("source").agg(F.count_if(F.col("track") == "audio").alias("_n"))
    checked = tracks.where("track = 'audio'").join(counts.where(F.assert_true(F.col("_n") > 0, F.lit("No audio track available from selected capture source")).isNull()), "source", "right")
    return checked.drop("_n")


#: Files that a stream takes at once: a backlog is several micro-batches.
FILES = 1000


def _reader(spark: SparkSession, streaming: bool, files: int):
    return spark.readStream.option("maxFilesPerTrigger", files) if streaming else spark.read


def events(spark: SparkSession, path: str, streaming: bool = False, files: int = FILES) -> DataFrame:
    """The event log from JSON lines in a folder."""
    return _reader(spark, streaming, files).schema(EVENT_LOG).json(path)


def messages(spark: SparkSession, path: str, streaming: bool = False, files: int = FILES) -> DataFrame:
    """Messages as they came, one a line, in `message`."""
    return _reader(spark, streaming, files).text(path).withColumnRenamed("value", "message")


def defaults(spark: SparkSession) -> DataFrame:
    """The stored settings of a new installation."""
    return spark.createDataFrame([(DEFAULT_TOPIC, DEFAULT_TEMPLATE, tuple(settings.OVERLAY.values()), "", "")], STORED)


def read_settings(spark: SparkSession, path: str | None = None, key: str | None = None, environment: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    """The settings in use, one row: topic, topicPromptTemplate, overlay, apiKeys. Missing fields have their defaults;
    empty keys come from the environment, DEEPGRAM_API_KEY and OPENAI_API_KEY. lines: documents of many installations, one a
    line, each of which gives a row."""
    env = os.environ if environment is None else environment
    base = defaults(spark)
    own = spark.read.schema(STORED).json(path, multiLine=not lines) if path else base
    both = own.alias("s").join(base.alias("d"), F.lit(True))  # one row and one row
    keep = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"d.{c}"))
    use = lambda c, e: settings.resolved(settings.decrypted(keep(c), key), F.lit(env.get(e, "")))
    keys = F.struct(use("deepgramApiKey", "DEEPGRAM_API_KEY").alias("deepgramApiKey"), use("openAiApiKey", "OPENAI_API_KEY").alias("openAiApiKey"))
    return both.select(keep("topic").alias("topic"), keep("topicPromptTemplate").alias("topicPromptTemplate"), keep("overlay").alias("overlay"), keys.alias("apiKeys"))


def write_settings(in_use: DataFrame, path: str, key: str | None = None) -> None:
    """Stores settings in use as the flat document, keys encrypted."""
    flat = in_use.select("topic", "topicPromptTemplate", "overlay", *[settings.encrypted(F.col(f"apiKeys.{k}"), key).alias(k) for k in ("deepgramApiKey", "openAiApiKey")])
    flat.write.mode("overwrite").json(path)


def update_topic(in_use: DataFrame, topic: str) -> DataFrame:
    return in_use.withColumn("topic", F.lit(topic))


def update_overlay(in_use: DataFrame, **patch: float) -> DataFrame:
    """Changes the given fields of the window and no others."""
    wanted = F.struct(*[F.lit(patch.get(n)).cast("double").alias(n) for n in settings.OVERLAY])
    return in_use.withColumn("overlay", settings.merged(F.col("overlay"), wanted))


def update_keys(in_use: DataFrame, deepgram: str, openai: str) -> DataFrame:
    return in_use.withColumn("apiKeys", F.struct(F.lit(deepgram).alias("deepgramApiKey"), F.lit(openai).alias("openAiApiKey")))


def failed(rows: DataFrame, message: str = "message") -> DataFrame:
    """Errors of the speech service as interim transcripts: adds `text` and `is_final`."""
    return rows.withColumn("text", labels.failure("stt", F.col(message))).withColumn("is_final", F.lit(False))
