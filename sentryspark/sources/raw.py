"""Raw messages: reading the topic, decoding, dead letters, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.functions.normalize import normalize_event_type
from sentryspark.schema import RAW_EVENT_FIELDS

# Error names and texts, header names, suffix of the dead-letter topic.
DECODE_ERROR = "EventDeserializationException"
NULL_ERROR = "InvalidOperationException"
NULL_MESSAGE = "Deserialized to null"
POSITION_MESSAGE = "Failed to deserialize event at partition "
ERROR_LIMIT = 500
HEADER_PREFIX = "x-orig-"
DEAD_LETTER_SUFFIX = ".dead-letter"
EMPTY_ID = "00000000-0000-0000-0000-000000000000"
ID_PATTERN = r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"

RECORD_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp", "headers"]
HEADERS = "array<struct<key:string,value:binary>>"


def read_event_stream(
    spark: SparkSession, brokers: str, topic: str, group: str, max_offsets: int = 1_000_000
) -> DataFrame:
    """The topic from its start; offsets are kept in the query's checkpoint."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
        .option("groupIdPrefix", group).option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets).option("includeHeaders", "true")
        .load().select(*RECORD_COLUMNS)
    )


def records_from_text(lines: DataFrame, topic: str = "files") -> DataFrame:
    """Text lines (batch or file stream) in the shape of topic records."""
    return lines.select(
        F.lit(None).cast("binary").alias("key"), F.encode("value", "UTF-8").alias("value"),
        F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
        F.xxhash64("value").alias("offset"), F.current_timestamp().alias("timestamp"),
        F.lit(None).cast(HEADERS).alias("headers"),
    )


def computed_once(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Add columns that the optimizer will not copy into every expression that reads them.

    The row passes through a one-element array: unlike a projection, later steps and filters
    are not merged with what is computed here.
    """
    row = F.struct(*df.columns, *[column.alias(name) for name, column in added.items()])
    return df.select(F.inline(F.array(row)))


def typed_value(value: Column, raw: Column, name: str, wanted: str) -> tuple[Column, Column]:
    """(typed column, is it acceptable) for one message field; strict about JSON kinds."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    absent = kind == "VOID"
    text = F.try_variant_get(value, "$", "string")
    if wanted == "INT":
        number = F.try_variant_get(value, "$", "int")
        whole = (kind == "BIGINT") & number.isNotNull() & raw.rlike(r"^-?[0-9]+$")
        return number, absent | whole
    if wanted == "DOUBLE":
        number = F.try_variant_get(value, "$", "double")
        return number, absent | kind.rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    if wanted == "TIMESTAMP":
        moment = text.try_cast("timestamp")
        # A time or id that is there must be valid; JSON null is not.
        given = (kind == "STRING") & text.rlike(ISO_PATTERN) & moment.isNotNull()
        return moment, value.isNull() | given
    if name == "extra":
        return raw, absent | kind.startswith("OBJECT")
    if name == "eventId":
        return text, value.isNull() | ((kind == "STRING") & text.rlike(ID_PATTERN))
    return text, absent | (kind == "STRING")


def decode_events(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their typed ``event``, and the records that are no event.

    Field names match in any case and unknown ones are dropped. Anything but an object,
    or a field of another JSON kind, makes the record a dead letter.
    """
    text = F.col("value").cast("string")
    parsed = F.try_parse_json(text)
    read = computed_once(records, {
        "_null": F.coalesce(F.schema_of_variant(parsed) == "VOID", F.lit(False)),
        "_typed": F.try_variant_get(parsed, "$", "map<string,variant>"),
        "_written": F.from_json(text, "map<string,string>"),
    })
    # Lower-case name -> name as written; of names that differ in case only, the last counts.
    names = F.map_keys("_written")
    named = computed_once(read, {
        "_names": F.map_from_arrays(F.transform(names, F.lower), names),
    })
    fields, checks = [], []
    for name, wanted in RAW_EVENT_FIELDS.items():
        key = F.col("_names")[name.lower()]
        value, accepted = typed_value(F.col("_typed")[key], F.col("_written")[key], name, wanted)
        fields.append(value.alias(name))
        checks.append(F.when(~F.coalesce(accepted, F.lit(False)), F.lit(name)))
    faults = F.array_compact(F.array(*checks))
    known = F.col("_typed").isNotNull()
    message = (
        F.when(F.col("_null"), F.lit(NULL_MESSAGE))
        .when(~known, F.lit("The message is not a JSON object"))
        .otherwise(F.concat(F.lit("Wrong kind of value for: "), F.array_join("_faults", ", ")))
    )
    at = F.concat(
        F.lit(POSITION_MESSAGE), F.col("partition").cast("string"),
        F.lit(" offset "), F.col("offset").cast("string"), F.lit(": "), message,
    )
    checked = computed_once(named, {
        "event": F.struct(*fields),
        "_faults": F.when(known, faults).otherwise(F.array(F.lit("message"))),
    })
    kept = checked.where(F.size("_faults") == 0).select(*records.columns, "event")
    bad = checked.where(F.size("_faults") > 0).select(
        *records.columns,
        F.when(F.col("_null"), F.lit(NULL_ERROR)).otherwise(F.lit(DECODE_ERROR)).alias("error_type"),
        F.when(F.col("_null"), message).otherwise(at).alias("error_message"),
    )
    return kept, bad


def dead_letters(bad: DataFrame) -> DataFrame:
    """Records for the dead-letter topic: original key and value, reasons as headers."""
    facts = {
        "x-original-topic": F.col("topic"),
        "x-original-partition": F.col("partition").cast("string"),
        "x-original-offset": F.col("offset").cast("string"),
        "x-error-type": F.col("error_type"),
        "x-error-message": F.substring("error_message", 1, ERROR_LIMIT),
        "x-dead-lettered-at": F.date_format(
            F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "x-retry-count": F.lit("0"),
    }
    added = F.array(*[
        F.struct(F.lit(name).alias("key"), F.encode(text, "UTF-8").alias("value"))
        for name, text in facts.items()
    ])
    original = F.transform("headers", lambda h: F.struct(
        F.concat(F.lit(HEADER_PREFIX), h["key"]).alias("key"), h["value"].alias("value")
    ))
    headers = F.concat(added, F.coalesce(original, F.array().cast(HEADERS)))
    return bad.select(
        "key", "value", F.concat("topic", F.lit(DEAD_LETTER_SUFFIX)).alias("topic"),
        headers.alias("headers"),
    )


def record_identity() -> Column:
    """Event id derived from the topic position, so that a retry gives the same id."""
    digest = F.sha2(F.concat_ws(":", "topic", "partition", "offset"), 256)
    starts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in starts])


def normalize_events(decoded: DataFrame) -> DataFrame:
    """Canonical events of decoded records: defaults, one event vocabulary, properties.

    A missing id comes from the topic position and a missing time from the record, so both
    stay the same when the record is read again.
    """
    given_id = F.when(F.col("event.eventId") != EMPTY_ID, F.lower("event.eventId"))
    given_time = F.when(F.year("event.timestamp") > 1, F.col("event.timestamp"))
    return decoded.select(
        F.coalesce(given_id, record_identity()).alias("event_id"),
        F.coalesce(given_time, F.col("timestamp")).alias("timestamp"),
        F.coalesce("event.agentId", F.lit("unknown")).alias("agent_id"),
        F.coalesce("event.agentName", F.lit("unknown")).alias("agent_name"),
        F.coalesce("event.sessionId", F.lit("")).alias("session_id"),
        F.coalesce("event.traceId", F.lit("")).alias("trace_id"),
        normalize_event_type(F.coalesce("event.eventType", F.lit("unknown"))).alias("event_type"),
        F.col("event.modelId").alias("model_id"),
        F.col("event.inputTokens").alias("input_tokens"),
        F.col("event.outputTokens").alias("output_tokens"),
        F.col("event.latencyMs").alias("latency_ms"),
        F.col("event.toolName").alias("tool_name"),
        F.col("event.toolInput").alias("tool_input"),
        F.col("event.toolOutput").alias("tool_output"),
        F.col("event.contentHash").alias("content_hash"),
        extras_to_properties().alias("properties"),
        F.col("partition").cast("smallint").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )


def extras_to_properties() -> Column:
    """The message's ``extra`` object as JSON text, ``{}`` when absent."""
    return F.coalesce("event.extra", F.lit("{}"))
