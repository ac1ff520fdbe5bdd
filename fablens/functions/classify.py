"""Category of an event: keywords, allow-list, equipment class and validation of a supplied result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens import constants as C
from fablens.operators.skew import any_of

RESULT_SCHEMA = "category STRING, root_cause STRING, recommended_action STRING, confidence DOUBLE"


def keyword_category(
    message: Column,
    event_type: Column | None = None,
    source: Column | None = None,
    keywords: Sequence[tuple[str, Sequence[str]]] = C.CATEGORY_KEYWORDS,
) -> Column:
    """First category, in the table's order, one of whose keywords occurs in the lower-cased texts."""
    parts = [F.coalesce(c, F.lit("")) for c in (message, event_type, source) if c is not None]
    text = F.lower(F.concat_ws(" ", *parts))
    result = None
    for category, words in keywords:
        hit = any_of([F.contains(text, F.lit(w)) for w in words])
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise("unknown")


def allowed_category(category: Column, allowed: Sequence[str] = tuple(C.DEFAULT_CATEGORIES)) -> Column:
    return F.when(category.isin(list(allowed)), category).otherwise("unknown")


def validated_result(text: Column, allowed: Sequence[str] = tuple(C.DEFAULT_CATEGORIES)) -> Column:
    """Classification result from JSON text: confidence clipped to [0, 1], category checked.

    Text that is no JSON object gives the fixed 'manual review' result.
    """
    failed_category, failed_cause, failed_action, failed_confidence = C.FAILED_CLASSIFICATION
    # Read as plain text first: a confidence that is no number is a failure of the whole result.
    fields = F.from_json(text, "MAP<STRING,STRING>")
    given = F.try_element_at(fields, F.lit("confidence"))
    number = given.try_cast("double")
    ok = fields.isNotNull() & (given.isNull() | number.isNotNull())
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(C.DEFAULT_CLASSIFICATION_CONFIDENCE))))
    read = lambda name: F.try_element_at(fields, F.lit(name))
    return F.when(
        ok,
        F.struct(
            allowed_category(read("category"), allowed).alias("category"),
            read("root_cause").alias("root_cause"),
            read("recommended_action").alias("recommended_action"),
            clipped.alias("confidence"),
        ),
    ).otherwise(
        F.struct(
            F.lit(failed_category).alias("category"),
            F.lit(failed_cause).alias("root_cause"),
            F.lit(failed_action).alias("recommended_action"),
            F.lit(failed_confidence).alias("confidence"),
        )
    )


def equipment_class(source: Column) -> Column:
    """Upper-cased machine name without its kind token, up to the first dash."""
    return F.substring_index(F.regexp_replace(F.upper(source), "TOOL_|MACHINE_|DEVICE_", ""), "-", 1)


def equipment_family(source: Column) -> Column:
    """Names of all equipment families with an alias inside the source."""
    name = F.upper(source)
    hits = [
        F.when(any_of([F.contains(name, F.lit(t)) for t in tokens]), F.lit(family))
        for family, tokens, _ in C.EQUIPMENT_FAMILIES
    ]
    return F.array_compact(F.array(*hits))


def candidate_categories(source: Column) -> Column:
    """Distinct categories of all matching equipment families, sorted."""
    name = F.upper(source)
    hits = [
        F.when(any_of([F.contains(name, F.lit(t)) for t in tokens]), F.array(*[F.lit(c) for c in categories]))
        for _, tokens, categories in C.EQUIPMENT_FAMILIES
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*hits)))))


def valid_category_name(name: Column) -> Column:
    """Trimmed, lower-cased category name, or null if the form is not allowed."""
    clean = F.lower(F.regexp_replace(name, r"^[\s\x0B\x{0085}\x{00A0}\x1C-\x1F]+|[\s\x0B\x{0085}\x{00A0}\x1C-\x1F]+$", ""))
    return F.when(F.rlike(clean, F.lit(C.CATEGORY_NAME_PATTERN)), clean)


def flatten_result(df: DataFrame, nested: str = "ai_normalized") -> DataFrame:
    """Move the fields of a nested classification result to the row, with their defaults; a flat frame stays as it is."""
    if nested not in df.columns:
        return df
    field = lambda name, default: F.coalesce(F.col(f"{nested}.{name}"), F.lit(default))
    return df.withColumns({
        "ai_category": field("category", "unknown"),
        "ai_root_cause": field("root_cause", "unknown"),
        "ai_recommended_action": field("recommended_action", ""),
        "confidence_score": field("confidence", 0.0),
    }).drop(nested)
