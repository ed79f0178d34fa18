"""Field access for conditions: a path in camelCase to its text, number and presence.

Text follows the invariant forms that rule authors write against: booleans read
``True``/``False``, whole doubles have no ``.0``, a JSON null reads as empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentryspark.schema import SEVERITIES

# Condition field name -> event column.
KNOWN_FIELDS = {
    "eventType": "event_type",
    "agentId": "agent_id",
    "agentName": "agent_name",
    "sessionId": "session_id",
    "modelId": "model_id",
    "inputTokens": "input_tokens",
    "outputTokens": "output_tokens",
    "latencyMs": "latency_ms",
    "toolName": "tool_name",
    "toolInput": "tool_input",
    "toolOutput": "tool_output",
    "contentHash": "content_hash",
}
INTEGER_FIELDS = {"inputTokens", "outputTokens"}
PROPERTY_PREFIX = "properties."
PROPERTY_MAP = "_property_text"

# Sign, digits with optional point, exponent; or one of the three special words.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_NUMBER_PATTERN = r"(?i)^([+-]?nan|[+-]?infinity)$"


class FieldValue:
    """A resolved field as SQL text; each form is written only when a condition asks for it."""

    def __init__(
        self, text: Callable[[], str], present: Callable[[], str], number: str | None = None
    ):
        self._text, self._present, self._number = text, present, number

    @property
    def text(self) -> str:
        return self._text()

    @property
    def present(self) -> str:
        return self._present()

    @property
    def number(self) -> str:
        """The field as a double: its own value, or its text parsed."""
        return self._number if self._number is not None else number_of_text(self.text)


def sql_string(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def property_key(path: str) -> str | None:
    """Key in the property map, or None when the path is a known event field."""
    if path in KNOWN_FIELDS:
        return None
    return path[len(PROPERTY_PREFIX):] if path.startswith(PROPERTY_PREFIX) else path


def with_property_map(events: DataFrame) -> DataFrame:
    """Add the parsed top-level property texts once, for all conditions that look there."""
    return events.withColumn(
        PROPERTY_MAP, F.from_json("properties", "map<string,string>")
    )


def resolve_field(path: str) -> FieldValue:
    """Text, presence and number of ``path``; unknown names look in the property map.

    Keys are flat: ``properties.a.b`` is the key ``a.b``. Needs ``with_property_map``
    when the path is not a known field.
    """
    key = property_key(path)
    if key is not None:
        name = sql_string(key)
        present = f"coalesce(map_contains_key({PROPERTY_MAP}, {name}), false)"
        return FieldValue(
            lambda: f"CASE WHEN {present} THEN {property_text(name)} END", lambda: present
        )
    column = KNOWN_FIELDS[path]
    present = f"({column} IS NOT NULL)"
    if path == "latencyMs":
        return FieldValue(lambda: double_text(column), lambda: present, column)
    if path in INTEGER_FIELDS:
        return FieldValue(
            lambda: f"CAST({column} AS STRING)", lambda: present, f"CAST({column} AS DOUBLE)"
        )
    return FieldValue(lambda: column, lambda: present)


def property_text(key: str) -> str:
    """Text of one JSON property; ``key`` is a SQL literal.

    The string map keeps raw number text (``1.0``); only a value that reads true/false
    needs the typed parse, to tell a JSON boolean from a string.
    """
    text = f"{PROPERTY_MAP}[{key}]"
    typed = f"from_json(properties, 'map<string,variant>')[{key}]"
    return f"""coalesce(CASE WHEN {text} IN ('true', 'false')
        AND schema_of_variant({typed}) = 'BOOLEAN' THEN initcap({text}) ELSE {text} END, '')"""


def double_text(column: str) -> str:
    """Shortest invariant text of a double: ``500`` not ``500.0``, ``1E+16`` from 1e15 up."""
    plain = f"CAST({column} AS STRING)"
    digits = f"regexp_replace(CAST(try_cast({plain} AS DECIMAL(38,22)) AS STRING), '[.]?0+$', '')"
    mantissa = f"regexp_replace(split_part({plain}, 'E', 1), '[.]0$', '')"
    exponent = f"try_cast(split_part({plain}, 'E', 2) AS INT)"
    return f"""CASE WHEN NOT contains({plain}, 'E') THEN regexp_replace({plain}, '[.]0$', '')
        WHEN abs({column}) >= 1e-4 AND abs({column}) < 1e15 THEN {digits}
        ELSE concat({mantissa}, CASE WHEN {exponent} < 0 THEN 'E-' ELSE 'E+' END,
          lpad(CAST(abs({exponent}) AS STRING), 2, '0')) END"""


def number_of_text(text: str) -> str:
    """Invariant parse of text to double, NULL when it is not a number.

    The pattern guards against forms the cast alone would take, such as ``1d``.
    """
    trimmed = f"trim({text})"
    return f"""CASE WHEN {trimmed} RLIKE {sql_string(NUMBER_PATTERN)}
        THEN try_cast({trimmed} AS DOUBLE)
        WHEN {trimmed} RLIKE {sql_string(SPECIAL_NUMBER_PATTERN)}
        THEN CASE WHEN lower({trimmed}) LIKE '%nan' THEN double('NaN')
          WHEN {trimmed} LIKE '-%' THEN double('-Infinity') ELSE double('Infinity') END END"""


def parse_number(column: str) -> Column:
    """``number_of_text`` of a column."""
    return F.expr(number_of_text(column))


def severity_order(column: Column) -> Column:
    """0..3 by rank; anything unknown ranks lowest."""
    rank = F.lit(0)
    for order, name in enumerate(SEVERITIES):
        rank = F.when(column == name, F.lit(order)).otherwise(rank)
    return rank


def severity_text(column: Column) -> Column:
    """Lower-case severity; anything unknown becomes ``medium``."""
    lowered = F.lower(column)
    return F.when(lowered.isin(SEVERITIES), lowered).otherwise(F.lit("medium"))


def event_millis(column: Column | str = "timestamp") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(column.cast("timestamp"))


def time_bucket(unit: str, column: Column | str = "timestamp") -> Column:
    """Start of the UTC hour or day that holds ``column``."""
    return F.date_trunc(unit, column)
