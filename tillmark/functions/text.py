"""Labels and numbers written in text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.sources import seeds

# What is not a number in a report (dates, ISO weeks, "3 March 2026", bare years 19xx and 20xx),
# and what is (optional sign, digits with commas, decimals, then an optional %, k or m).
DATE_LIKE = (
    r"(?iU)\b\d{4}-\d{2}-\d{2}\b|\b\d{4}-W\d{2}\b|\bW\d{2}\b"
    r"|\b\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4}\b"
    r"|\b(?:19|20)\d{2}\b"
)
NUMBER_LIKE = r"(?iU)(?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?(?:\s?(?:%|k\b|m\b))?"
ANY_DIGIT = r"(?U)\d"

# Names that mean the same as a region code or a country code.
COUNTRY_ALIASES = {"newzealand": "nz", "australia": "au"}

#: An answer's first number by parts: sign, whole digits, decimals, suffix. Commas and currency marks may stand anywhere.
_MARKS = r"(?:[,$]|nzd)*"
ANSWER = rf"(?is)(-?){_MARKS}(\d(?:[\d,$]|nzd)*)(?:\.{_MARKS}(\d(?:[\d,$]|nzd)*))?(?:\s|[,$]|nzd)*(%|k|thousand|m)?"
#: A number of a report by parts: whole digits, decimals, unit.
SHOWN = r"(?iU)^[-+]?(\d[\d,]*)(?:\.(\d+))?\s?([%km]?)$"
#: What a suffix multiplies and divides a number by.
SCALES = {"%": (1.0, 100.0), "k": (1e3, 1.0), "thousand": (1e3, 1.0), "m": (1e6, 1.0)}


def label_aliases() -> dict[str, str]:
    regions = {code.lower(): name.lower() for code, name, _ in seeds.REGIONS}
    return {**regions, **COUNTRY_ALIASES}


def normalise_label(label: Column) -> Column:
    """Lower case, letters and digits only, with region codes and country names brought to one spelling."""
    bare = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(_map_of(label_aliases()), bare), bare)


def _map_of(values: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _assembled(whole: Column, decimals: Column) -> Column:
    """The number that two runs of digits write; NULL without a whole part."""
    digits = F.concat_ws(".", *(F.regexp_replace(part, r"(?i)[,$nzd]", "") for part in (whole, F.concat(decimals, F.lit("0")))))
    return F.when(whole != "", digits).try_cast("double")


def parse_number(text: Column) -> Column:
    """The first number in an answer: ``NZD 139,973.90``, ``47.2%`` (0.472), ``12k``, ``1.2M``; NULL without digits.

    Whatever follows the number decides its scale by its first letters, so ``5 kg`` is 5000.
    """
    sign, whole, decimals, suffix = (F.regexp_extract(text, ANSWER, i) for i in range(1, 5))
    # each part stands once in the expression, so the code generated for it stays small
    size = _assembled(whole, decimals) * F.when(sign == "-", -1.0).otherwise(1.0)
    times, over = (
        F.coalesce(F.try_element_at(_map_of({name: pair[i] for name, pair in SCALES.items()}), F.lower(suffix)), F.lit(1.0)) for i in (0, 1)
    )
    return size * times / over


def number_texts(text: Column) -> Column:
    """Array of the numbers written in a text, as written; texts without any digit are not searched further."""
    cleaned = F.regexp_replace(text, DATE_LIKE, " ")
    return F.when(text.rlike(ANY_DIGIT), F.regexp_extract_all(cleaned, F.lit(NUMBER_LIKE), F.lit(0)))


def number_tokens(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per number in each text: the text as written, its absolute value, decimals shown and unit."""
    found = texts.select(F.col(key), F.posexplode(number_texts(F.col(text))).alias("position", "raw"))
    written = found.withColumn("token", F.trim("raw"))
    whole, decimals, unit = (F.regexp_extract("token", SHOWN, i) for i in range(1, 4))
    return written.select(
        key,
        "position",
        "token",
        _assembled(whole, decimals).alias("value"),
        F.length(decimals).alias("decimals"),
        F.lower(unit).alias("unit"),
    )
