"""Text views of cases: nested ones of JSON files, and flat rows of a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.functions.scalars import clip, strip

# Clip lengths of element fields for nested cases and for database rows.
ELEMENT_LENGTHS = {
    "actor_main": (100, 200), "actor_main_type": (50, 80), "ai_system": (100, 150), "domain": (50, 80), "event_type": (100, 150),
    "event_cause": (500, 800), "event_process": (500, 800), "event_result": (500, 800), "ai_risk_description": (500, 1200),
    "ai_risk_type": (100, 150), "ai_risk_subtype": (100, 150), "harm_type": (100, 150), "affected_actor_type": (100, 150),
    "affected_actor_subtype": (100, 150), "risk_stage": (100, 150), "harm_severity": (50, 80), "realized_or_potential": (50, 80),
}
# Element fields that are lists, items taken and the length of one.
LIST_FIELDS = ("actor_list", "ai_system_list", "ai_system_type_list", "ai_system_domain_list")
LIST_LENGTH, LIST_ITEMS = 100, 10
# Lines of the event view and their clip lengths.
EVENT_LINES = (("Title", 200), ("Time", 10), ("EventType", 100), ("Subject", 200), ("Actors", 100), ("AITech", 100), ("AIRisk", 200), ("Cause", 400), ("Process", 400), ("Result", 200))
# The whole length of a view of a nested case and of a database row.
VIEW_LENGTH, DATABASE_LENGTH = 6000, 7000
# Columns of a database row that are named otherwise than the element.
DATABASE_NAMES = {"actor_main": "event_actor_main", "actor_main_type": "event_actor_main_type", "actor_list": "event_actor_list", "ai_system": "event_ai_system", "domain": "event_domain"}
_RISK = ("ai_risk_description", "ai_risk_type", "ai_risk_subtype", "harm_type", "harm_severity", "affected_actor_type", "affected_actor_subtype", "realized_or_potential", "risk_stage")


def field(df: DataFrame, path: str) -> Column:
    """A field of nested columns as it is; null where the schema lacks it."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[name].dataType
    return F.col(path)


def is_list(df: DataFrame, path: str) -> bool:
    kind: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return isinstance(kind, T.ArrayType)


def parsed_list(c: Column) -> Column:
    """A JSON list as its items, another text as one item; nothing for null or blank."""
    return F.coalesce(F.from_json(c, "array<string>"), F.when(strip(c) != "", F.array(strip(c))), F.array().cast("array<string>"))


def items(df: DataFrame, path: str) -> Column:
    """A list field as an array of texts, whether it is an array, a JSON text or a single value."""
    own = field(df, path)
    return F.coalesce(own.cast("array<string>"), F.array().cast("array<string>")) if is_list(df, path) else parsed_list(own.cast("string"))


def taken(array: Column, n: int = LIST_LENGTH, most: int = LIST_ITEMS, blanks_first: bool = False) -> Column:
    """Clipped items; blank ones are dropped after the first ``most`` are taken (or before)."""
    full = lambda xs: F.filter(xs, lambda x: x != "")
    clipped = lambda xs: F.transform(xs, lambda x: clip(x, n))
    return F.slice(full(clipped(array)), 1, most) if blanks_first else full(clipped(F.slice(array, 1, most)))


def joined_list(array: Column | str, n: int = LIST_LENGTH, most: int = LIST_ITEMS, blanks_first: bool = False) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.coalesce(F.array_join(taken(array, n, most, blanks_first), ", "), F.lit(""))


def _joined_whole(array: Column, n: int) -> Column:
    """The first items, blank ones too."""
    return F.coalesce(F.array_join(F.transform(F.slice(array, 1, LIST_ITEMS), lambda x: clip(x, n)), ", "), F.lit(""))


def text_view(title: Column | str, body: Column | str, title_n: int = 200, body_n: int = 6000, most: int | None = None) -> Column:
    """Title and body; never empty, as the labels stand."""
    whole = strip(F.concat(F.lit("Title: "), clip(title, title_n), F.lit("\nBody: "), clip(body, body_n)))
    return whole if most is None else F.substring(whole, 1, most)


def event_type_of(event_type: Column | str, first_risk: Column | str) -> Column:
    """The part before a full-width bracket, else the first 20 characters of the first risk."""
    own = strip(F.substring_index(F.coalesce(F.col(event_type) if isinstance(event_type, str) else event_type, F.lit("")), "（", 1))
    return F.when(own != "", own).otherwise(clip(first_risk, 20))


def _lines(fields: dict[str, Column], most: int) -> Column:
    return F.substring(strip(F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(fields.get(name, F.lit("")), F.lit(""))) for name, _ in EVENT_LINES])), 1, most)


def event_view(fields: dict[str, Column], most: int = VIEW_LENGTH) -> Column:
    """Ten labelled lines in fixed order, stripped and cut. fields: line label to column; lists must be joined."""
    return _lines({name: clip(fields[name], n if name not in ("Actors", "AITech") else 10 * n) for name, n in EVENT_LINES if name in fields}, most)


def _with_system(systems: Column, system: Column) -> Column:
    """The list with the main system before it, unless it is empty or in the list."""
    return F.when((system != "") & ~F.array_contains(systems, system), F.concat(F.array(system), systems)).otherwise(systems)


def _time(start: Column, release: Column) -> Column:
    return F.substring(F.when(start != "", start).otherwise(release), 1, 10)


def _annotated(df: DataFrame) -> dict[str, Column]:
    """Lines from event_annotation, ai_risk and ai_tech."""
    at = lambda path, n: clip(field(df, path), n)
    system = at("event_annotation.ai_system", 100)
    risk = [at(f"ai_risk.{f}", n) for f, n in (("ai_risk_type", 100), ("ai_risk_subtype", 100), ("ai_risk_description", 200))]
    return {
        "Time": at("event_annotation.event_time_start", 50), "EventType": at("event_annotation.event_type", 100), "Subject": at("event_annotation.actor_main", 200),
        "Actors": _joined_whole(items(df, "event_annotation.actor_list"), 100), "AITech": _joined_whole(_with_system(items(df, "ai_tech.ai_system_list"), system), 100),
        "AIRisk": F.array_join(F.filter(F.array(*risk), lambda x: x != ""), " | "),
        "Cause": at("event_annotation.event_cause", 400), "Process": at("event_annotation.event_process", 400), "Result": at("event_annotation.event_result", 200),
    }


def _filtered(df: DataFrame) -> dict[str, Column]:
    """Lines from _filter_metadata, whose subject is the only actor and whose first risk names the type."""
    at = lambda name, n: clip(field(df, f"_filter_metadata.incident_elements.{name}"), n)
    risks, tech = items(df, "_filter_metadata.ai_risk_elements"), _joined_whole(items(df, "_filter_metadata.ai_tech_elements"), 200)
    subject, first = at("Subject", 200), F.coalesce(F.get(risks, F.lit(0)), F.lit(""))
    kind = F.when(F.instr(first, "（") > 0, F.substring_index(first, "（", 1)).otherwise(F.substring(first, 1, 20))
    return {
        "Time": at("Time", 50), "EventType": F.when(subject != "", kind), "Subject": subject, "Actors": clip(subject, 100),
        "AITech": F.when(tech != "", tech).otherwise(_joined_whole(items(df, "ai_tech.ai_system_list"), 100)), "AIRisk": _joined_whole(risks, 200),
        "Cause": at("Cause", 500), "Process": at("Process", 500), "Result": at("Result", 500),
    }


def case_views(df: DataFrame) -> DataFrame:
    """df with ``text_view`` and ``event_view`` of nested cases; _filter_metadata goes before the annotation where it is there."""
    lines = _annotated(df)
    if "_filter_metadata" in df.columns and isinstance(df.schema["_filter_metadata"].dataType, T.StructType):
        other = _filtered(df)
        lines = {k: F.when(F.col("_filter_metadata").isNotNull(), other[k]).otherwise(v) for k, v in lines.items()}
    lines["Time"] = _time(F.coalesce(lines["Time"], F.lit("")), clip(field(df, "release_date"), 50))
    lines["Title"] = clip(field(df, "title"), 200)
    return df.withColumns({"text_view": text_view(field(df, "title"), field(df, "text")), "event_view": _lines(lines, VIEW_LENGTH)})


def database_views(df: DataFrame) -> DataFrame:
    """df with ``text_view`` and ``event_view`` of database rows: lists may be JSON texts, a risk has no subtype."""
    at = lambda name, n: clip(field(df, name), n)
    text = lambda name: F.coalesce(field(df, name).cast("string"), F.lit(""))
    risk = [at("ai_risk_type", 100), at("ai_risk_description", 200)]
    lines = {
        "Title": at("title", 200), "Time": _time(text("event_time_start"), text("release_date")), "EventType": at("event_type", 100), "Subject": at("event_actor_main", 200),
        "Actors": _joined_whole(items(df, "event_actor_list"), 100), "AITech": _joined_whole(_with_system(items(df, "ai_system_list"), at("event_ai_system", 100)), 100),
        "AIRisk": F.array_join(F.filter(F.array(*risk), lambda x: x != ""), " | "),
        "Cause": at("event_cause", 400), "Process": at("event_process", 400), "Result": at("event_result", 200),
    }
    return df.withColumns({"text_view": text_view(field(df, "title"), field(df, "content"), most=DATABASE_LENGTH), "event_view": _lines(lines, DATABASE_LENGTH)})


def _path(name: str, database: bool) -> str:
    if database:
        return DATABASE_NAMES.get(name, name)
    return f"{'ai_risk' if name in _RISK else 'ai_tech' if name in LIST_FIELDS[1:] else 'event_annotation'}.{name}"


def element_views(df: DataFrame, database: bool = False, empty_is_valid: bool = False, most: int = LIST_ITEMS, flat: bool = False) -> DataFrame:
    """df with every element field clipped, the four lists too, each with ``<field>_valid``.

    Nested cases keep blank items in the count of the first ``most``; database rows drop them before. A field that df lacks
    is empty. valid: not empty, or always if empty_is_valid (texts only). flat: elements are columns of their own names.
    """
    out = {}
    for name, lengths in ELEMENT_LENGTHS.items():
        out[name] = clip(field(df, name if flat else _path(name, database)), lengths[database])
        out[f"{name}_valid"] = F.lit(True) if empty_is_valid else out[name] != ""
    for name in LIST_FIELDS:
        out[name] = taken(items(df, name if flat else _path(name, database)), LIST_LENGTH, most, database)
        out[f"{name}_valid"] = F.size(out[name]) > 0
    return df.withColumns(out)
