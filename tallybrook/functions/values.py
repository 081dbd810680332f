"""Scalar column functions: vectors, defaults, JSON records and prompt lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that appear in results.
NOT_STATED = "не указано"
UP_TO = "до"
FROM = "от"
DEFAULT_CURRENCY = "RUB"
UNKNOWN_AUTHOR, NAMELESS_AUTHOR = "unknown", "неизвестный"
PAY, OWNER, TEAM, UPDATED = "зарплата", "овнер", "команда", "обновлено"
USER_LABEL, OTHER_LABEL = "Пользователь", "Ассистент"


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; null if either is null, empty, of zero norm or another length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm)


# The characters that count as white space at a text's ends.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def falsy_coalesce(value: Column, default: Column) -> Column:
    """The value, or the default where it is null or an empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def falsy_number(value: Column, default: Column) -> Column:
    """The number, or the default where it is null or 0."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("int")), default)


def whole(number: Column) -> Column:
    return F.floor(number).cast("long").cast("string")


def format_range(low: Column, high: Column, currency: Column) -> Column:
    """'low–high cur', 'до high cur', 'от low cur' or 'не указано'; 0 counts as missing."""
    cur = falsy_coalesce(currency, F.lit(DEFAULT_CURRENCY))
    has_low, has_high = F.coalesce(low != 0, F.lit(False)), F.coalesce(high != 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(whole(low), F.lit("–"), whole(high), F.lit(" "), cur))
        .when(has_high, F.concat(F.lit(f"{UP_TO} "), whole(high), F.lit(" "), cur))
        .when(has_low, F.concat(F.lit(f"{FROM} "), whole(low), F.lit(" "), cur))
        .otherwise(F.lit(NOT_STATED))
    )


def _bounds(low: Column, high: Column, currency: Column, before: str) -> Column:
    """', low–high cur' with '?' for a missing bound; empty if both are null or 0."""
    bound = lambda c: F.coalesce(whole(F.nullif(c, F.lit(0).cast("double"))), F.lit("?"))
    some = F.coalesce(low != 0, F.lit(False)) | F.coalesce(high != 0, F.lit(False))
    return F.when(some, F.concat(F.lit(before), bound(low), F.lit("–"), bound(high), F.lit(" "), falsy_coalesce(currency, F.lit(DEFAULT_CURRENCY)))).otherwise(F.lit(""))


def _named(label: str, value: Column) -> Column:
    """', label: value', empty for a null or empty value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f", {label}: "), value)).otherwise(F.lit(""))


def format_entity_line(title: Column, status: Column, low: Column, high: Column, currency: Column, team: Column, created_at: Column | None = None, *, owner: Column | None = None, updated_at: Column | None = None, variant: str = "list") -> Column:
    """An entity in one line: 'list' with range, team and date; 'prompt' with bounds and team, a missing status being open;
    'context' with bounds, owner, team and the day of its last update. What is missing is left out of the last two."""
    head = lambda st: F.concat(F.lit("- "), title, F.lit(" ["), st, F.lit("]"))
    none = F.lit(None).cast("string")
    if variant == "prompt":
        return F.concat(head(falsy_coalesce(status, F.lit("open"))), _bounds(low, high, currency, ", "), _named(TEAM, team))
    if variant == "context":
        day = F.date_format(updated_at, "yyyy-MM-dd") if updated_at is not None else none
        return F.concat(head(status), _bounds(low, high, currency, f", {PAY} "), _named(OWNER, owner if owner is not None else none), _named(TEAM, team), _named(UPDATED, day))
    if variant == "list":
        return F.concat_ws(", ", head(status), format_range(low, high, currency), falsy_coalesce(team, F.lit(NOT_STATED)), F.date_format(created_at, "yyyy-MM-dd"))
    raise ValueError(f"unknown variant {variant!r}")


def format_message_line(author: Column, at: Column | None, text: Column, *, variant: str = "context") -> Column:
    """'context': '[author (time)]: text', without the time if there is none; 'prompt': '- author: text'."""
    said = F.coalesce(text, F.lit(""))
    if variant == "prompt":
        return F.concat(F.lit("- "), falsy_coalesce(author, F.lit(UNKNOWN_AUTHOR)), F.lit(": "), said)
    if variant != "context":
        raise ValueError(f"unknown variant {variant!r}")
    time = F.coalesce(F.concat(F.lit(" ("), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(")")), F.lit("")) if at is not None else F.lit("")
    return F.concat(F.lit("["), falsy_coalesce(author, F.lit(NAMELESS_AUTHOR)), time, F.lit("]: "), said)


def format_turns(turns: Column) -> Column:
    """Turns (array of role, text, ...) as lines 'label: text', the user's and everybody else's."""
    label = lambda t: F.when(t["role"] == "user", USER_LABEL).otherwise(OTHER_LABEL)
    return F.array_join(F.transform(turns, lambda t: F.concat(label(t), F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")


def parse_json_record(text: Column, schema: T.StructType, default: Column, valid=None) -> Column:
    """JSON text as a struct; anything that can't be read, or that ``valid`` refuses, is the default."""
    got = F.from_json(text, schema)
    usable = got.isNotNull() & F.coalesce(F.get_json_object(text, "$").isNotNull(), F.lit(False))
    if valid is not None:
        usable = usable & F.coalesce(valid(got), F.lit(False))
    return F.when(usable, got).otherwise(default)


def json_value(value: Column, number: bool = False) -> Column:
    """A value as JSON text: numbers bare, texts quoted with non-ASCII letters kept, null as null."""
    return F.coalesce(value.cast("string"), F.lit("null")) if number else F.regexp_extract(F.to_json(F.array(value), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)


def json_diff(parts: list[tuple[str, Column, Column]]) -> Column:
    """A JSON object of (name, whether it belongs, JSON text of its value), null if nothing belongs."""
    there = F.filter(F.array(*(F.when(c, F.concat(F.lit(f'"{n}":'), v)) for n, c, v in parts)), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.concat(F.lit("{"), F.array_join(there, ","), F.lit("}")))


def append_turns(turns: Column, role: Column, text: Column, at: Column) -> Column:
    """The array with one more turn; a null array is empty."""
    turn = F.struct(role.cast("string").alias("role"), text.alias("text"), at.cast("string").alias("ts"))
    return F.concat(F.coalesce(turns, F.array().cast("array<struct<role:string,text:string,ts:string>>")), F.array(turn))
