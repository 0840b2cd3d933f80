"""Tokens, prompt lines and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of the themes.
THEME_NAMES = {
    "wrong_or_missing_item": "Wrong / Missing Item",
    "never_arrived": "Never Arrived",
    "late_delivery": "Late Delivery",
    "damaged_product": "Damaged Product",
    "not_as_described": "Not as Described",
    "poor_quality": "Poor Quality",
    "refund_or_billing": "Refund / Billing",
    "other": "Other",
}


def words(text: Column) -> Column:
    """Lower-cased words of the whole text. Accents and combining marks are kept.

    Text that starts or ends with other characters yields an empty word there.
    """
    return F.split(F.lower(text.cast("string")), r"[^\p{L}\p{M}\p{N}]+")


def shorten(text: Column, max_chars: int | None) -> Column:
    """The first ``max_chars`` characters, or all of them for ``None``."""
    return text if max_chars is None else F.substring(text, 1, max_chars)


def prompt_line(review_id: Column, text: Column, max_chars: int | None = None) -> Column:
    return F.concat(
        F.lit("- review_id="), review_id.cast("string"), F.lit(": "), shorten(text.cast("string"), max_chars)
    )


def theme_name(theme: Column) -> Column:
    """Display name: the fixed one, else blanks for underscores and each word capitalised."""
    chunks = F.regexp_extract_all(F.replace(theme, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    titled = F.array_join(F.transform(chunks, F.initcap), "")
    name = titled
    for key, display in THEME_NAMES.items():
        name = F.when(theme == key, display).otherwise(name)
    return name
