"""City names brought to one spelling each: accents, punctuation and rare misspellings."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.sources.cache import materialize

RATIO = 10
SHORT, LONG = 5, 10


def _accents() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks with an accent, and the letters below the accents."""
    letters = [chr(point) for point in range(0xE0, 0x250)]
    bases = [(letter, unicodedata.normalize("NFKD", letter)) for letter in letters]
    kept = [(letter, base[0]) for letter, base in bases if len(base) > 1 and base[0].isascii() and base[0].isalpha()]
    return "".join(letter for letter, _ in kept), "".join(base for _, base in kept)


ACCENTED, PLAIN = _accents()


def folded(name: Column) -> Column:
    """The name in lower case, without accents, with one blank for whatever is no letter or digit."""
    plain = F.translate(F.lower(F.regexp_replace(name, r"\p{M}+", "")), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def edits_allowed(name: Column) -> Column:
    """0 edits for names below 5 characters, 1 below 10, 2 from there on."""
    size = F.length(name)
    return F.when(size < SHORT, 0).when(size < LONG, 1).otherwise(2)


def _rare_grams(names: DataFrame) -> DataFrame:
    """The 2 * edits + 1 rarest numbered letter pairs of each name.

    An edit changes two pairs at most, so names within the allowed edits share one of these.
    """
    padded = F.concat(F.lit("^"), "name", F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda at: F.substring(padded, at, F.lit(2)))
    grams = names.where("edits > 0").select("*", F.posexplode(pairs).alias("at", "gram"))
    grams = grams.withColumn("nth", F.row_number().over(Window.partitionBy("name", "gram").orderBy("at")))
    known = grams.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("names"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("names", "gram", "nth"))
    ranked = grams.join(known, ["gram", "nth"]).withColumn("place", place)
    return ranked.where(F.col("place") <= 2 * F.col("edits") + 1).select("name", "n", "edits", "digits", "gram", "nth")


def _targets(grams: DataFrame, ratio: int) -> DataFrame:
    """(name, target): the nearest name that is ``ratio`` times as frequent, ties by frequency and name."""
    size = F.length("name")
    rare = grams.withColumn("size", F.explode(F.sequence(size - F.col("edits"), size + F.col("edits"))))
    common = grams.select(
        F.col("name").alias("target"), F.col("n").alias("target_n"), F.col("edits").alias("target_edits"),
        "digits", "gram", "nth", size.alias("size"),
    )
    pairs = (
        rare.join(common, ["gram", "nth", "size", "digits"])
        .where(F.col("target_n") >= ratio * F.col("n"))
        .select("name", "target", "target_n", F.least("edits", "target_edits").alias("edits"))
        .distinct()
    )
    distance = F.levenshtein("name", "target")
    near = pairs.withColumn("distance", distance).where("distance <= edits")
    best = F.min(F.struct("distance", (-F.col("target_n")).alias("order"), "target"))
    return near.groupBy("name").agg(best["target"].alias("target"))


def city_identities(cities: DataFrame, root: str, city: str = "customer_city", ratio: int = RATIO) -> DataFrame:
    """(city, n, canonical) for every different spelling in the column ``city``.

    Spellings that fold to the same name are one city. A name is taken for a misspelling of another
    if that one has at least ``ratio`` (2 or more) times its rows, the same digits in the same order,
    and is within the edits allowed for the shorter of the two; of several the nearest counts, then
    the more frequent, then the smaller. Misspellings of misspellings follow up to the last name.
    ``canonical`` is its most frequent spelling, of equally frequent ones the smallest.

    Rows are counted first; only names are compared, and only names that share a rare letter pair.
    Every link multiplies the rows by ``ratio``, so chains are short and a fixed number of doubling
    steps ends them. Tables that are read twice are stored below ``root``. Null names give no row;
    a name without letter or digit folds to the empty name; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    counted = cities.where(F.col(city).isNotNull()).groupBy(F.col(city).alias("city")).agg(F.count(F.lit(1)).alias("n"))
    spellings = materialize(counted.withColumn("name", folded(F.col("city"))), f"{root}/spellings")
    names = materialize(
        spellings.groupBy("name")
        .agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("order"), "city"))["city"].alias("spelling"))
        .withColumns({"edits": edits_allowed(F.col("name")), "digits": F.regexp_replace("name", r"\P{N}+", "")}),
        f"{root}/names",
    )
    grams = materialize(_rare_grams(names), f"{root}/grams")
    ends = names.join(_targets(grams, ratio), "name", "left").select("name", F.coalesce("target", "name").alias("end"))
    ends = materialize(ends, f"{root}/ends_0")
    links = math.floor(63 * math.log(2) / math.log(ratio))
    for step in range(1, links.bit_length() + 1):
        further = ends.select(F.col("name").alias("end"), F.col("end").alias("further"))
        ends = ends.join(further, "end").select("name", F.col("further").alias("end"))
        ends = materialize(ends, f"{root}/ends_{step}")
    chosen = ends.join(names.select(F.col("name").alias("end"), F.col("spelling").alias("canonical")), "end")
    return spellings.join(chosen.select("name", "canonical"), "name").select("city", "n", "canonical")


def with_canonical_city(rows: DataFrame, identities: DataFrame, city: str = "customer_city") -> DataFrame:
    """The rows with their city replaced by its canonical spelling; unknown and null cities stay."""
    known = identities.select(F.col("city").alias(city), F.col("canonical").alias("_canonical"))
    joined = rows.join(known, city, "left")
    return joined.withColumn(city, F.coalesce("_canonical", city)).drop("_canonical").select(*rows.columns)
