"""Reading the labeler's answer: one JSON array of (review_id, theme, severity) objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The theme vocabulary, the fallback and the severities.
THEMES = (
    "never_arrived",
    "late_delivery",
    "wrong_or_missing_item",
    "damaged_product",
    "poor_quality",
    "not_as_described",
    "refund_or_billing",
    "other",
)
FALLBACK_THEME = "other"
SEVERITIES = ("low", "medium", "high")

LABEL_SCHEMA = "array<struct<review_id:string,theme:string,severity:string>>"


def parse_labels(answer: Column) -> Column:
    """The outermost array in ``answer`` (fences and prose around it are ignored).

    Null where there is no array, the array is broken or holds something other than objects, or
    the answer is a single JSON object.
    """
    array_text = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    lone_object = F.trim(answer).startswith("{") & F.get_json_object(answer, "$").isNotNull()
    parsed = F.from_json(array_text, LABEL_SCHEMA)
    return F.when(~lone_object & F.forall(parsed, lambda row: row.isNotNull()), parsed)


def clamp_theme(theme: Column) -> Column:
    """Anything outside the vocabulary, a missing theme too, becomes the fallback."""
    return F.when(theme.isin(*THEMES), theme).otherwise(F.lit(FALLBACK_THEME))
