"""Encodings of raw values as columns: results, outcomes, calendar, ages, recodings, labels, priorities."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of a missing result, and spellings of results.
MISSING_MARKS = ["", " ", "NA", "-", "."]
MISSING_TOKENS = ["", ".", "-", "na", "nan", "none", "missing", "null"]
RESULT_WORDS = {"R": ["r", "res", "resistant", "1"], "S": ["s", "sus", "susceptible", "0"], "I": ["i", "int", "intermediate"]}
#: The outcome of each result, by scheme, and the seasons by code.
OUTCOMES = {"RI_vs_S": {"R": 1, "I": 1, "S": 0}, "R_vs_SI": {"R": 1, "I": 0, "S": 0}, "ordinal_R2I1S0": {"R": 2, "I": 1, "S": 0}}
SEASONS = {1: "Winter", 2: "Spring", 3: "Summer", 4: "Fall"}


def lookup(value: Column, table: Mapping, default=None) -> Column:
    """The entry of a small fixed mapping, as one map literal; ``default`` where there is none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), value)
    return found if default is None else F.coalesce(found, F.lit(default))


def tested_flag(raw: Column) -> Column:
    """1 if any result is recorded, else 0."""
    return F.when(raw.isin(MISSING_MARKS), None).otherwise(raw).isNotNull().cast("tinyint")


def result_token(raw: Column) -> Column:
    """R, I or S; null for what is missing or can't be told. Of several results by slashes, the most severe counts."""
    s = F.lower(F.trim(raw.cast("string")))
    parts = F.transform(F.split(s, r"[\\/]"), F.trim)
    several = F.coalesce(*[F.when(F.array_contains(parts, x.lower()), x) for x in ("R", "I", "S")])
    first = F.upper(F.substring(s, 1, 1))
    out = F.when(s.isNull() | s.isin(MISSING_TOKENS), F.lit(None).cast("string"))
    for token, words in RESULT_WORDS.items():
        out = out.when(s.isin(words), token)
    return out.when(s.rlike(r"[\\/]"), several).when(first.isin("R", "I", "S"), first)


def outcome(token: Column, scheme: str = "R_vs_SI") -> Column:
    return lookup(token, OUTCOMES[scheme]).cast("tinyint")


def checked_outcome(flag: Column, value: Column) -> Column:
    """An outcome must be null where nothing was tested."""
    return F.when(flag == 1, value)


def calendar(date: Column) -> dict[str, Column]:
    code = (F.month(date) % 12 / 3).cast("int") + 1
    return {"year": F.year(date), "month": F.month(date), "month_name": F.date_format(date, "MMMM"), "year_month": F.date_format(date, "yyyy-MM"), "season_code": code, "season": lookup(code, SEASONS)}


#: Lower bounds of age bands: below one, one to four, then five years each, the last open.
AGE_BOUNDS = [0, 1, *range(5, 100, 5)]


def age(raw: Column) -> Column:
    """The first number of a text; -1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(raw.cast("string"), r"(\d+)", 1), F.lit("")).cast("int"), F.lit(-1))


def age_band(years: Column) -> Column:
    """Label of the band, right-open; null for negative ages and from 120 on."""
    out = F.when((years < 0) | (years >= 120), F.lit(None).cast("string")).when(years >= 95, "≥95 years").when(years < 1, "0 years")
    for low, high in zip(AGE_BOUNDS[1:], AGE_BOUNDS[2:], strict=False):
        out = out.when(years < high, f"{low}-{high - 1} years")
    return out


def age_range(years: Column) -> Column:
    """Bands of fifteen years."""
    out = F.when((years < 0) | (years >= 120), F.lit(None).cast("string")).when(years < 15, "<15")
    for low in range(15, 90, 15):
        out = out.when(years < low + 15, f"{low}–{low + 14}")
    return out.otherwise("90+")


def age_group(years: Column) -> Column:
    """Broad groups by life phase."""
    out = F.when((years < 0) | (years >= 120), F.lit(None).cast("string"))
    for high, label in ((1, "Infants"), (5, "Early Childhood"), (15, "Late Childhood"), (25, "Adolescents & Young Adults"), (40, "Early Middle Age"), (55, "Late Middle Age"), (65, "Pre-Senior"), (80, "Early Elderly"), (120, "Late Elderly")):
        out = out.when(years < high, label)
    return out


def label_parts(label: Column, suffix: str = "_Tested") -> dict[str, Column]:
    """``"CODE - Name<suffix>"`` as code, name and the whole without its suffix; a label without a dash is both."""
    whole = F.regexp_replace(label, re.escape(suffix) + "$", "")
    parts = F.split(whole, " - ", 2)
    return {"code": F.trim(parts[0]), "name": F.trim(F.coalesce(F.get(parts, F.lit(1)), parts[0])), "combined": whole}


def after_colon(text: Column) -> Column:
    return F.regexp_extract(text, r":\s*(.*)", 1)


def names_pattern(names: list[str]) -> str:
    """A pattern for any of the names as whole words."""
    return r"\b(?:" + "|".join(re.escape(n) for n in names) + r")\b"


def tier(text: Column, tiers: list[tuple[str, str]], default: str = "Other") -> Column:
    """The label of the first (label, pattern) that the text holds, whatever its case."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in tiers:
        out = out.when(text.rlike("(?i)" + pattern), label)
    return out.otherwise(default)


@lru_cache(1)
def _marked() -> tuple[str, str]:
    """Letters of the basic plane that decompose into a letter and marks, and these letters."""
    source, target = [], []
    for code in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.category(chr(code)).startswith("L") and all(unicodedata.combining(c) for c in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold(text: str) -> str:
    """What ``folded`` makes of a text."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.strip(" ").lower()) if not unicodedata.category(c).startswith("M"))
    return plain.replace("ß", "ss")


def folded(text: Column) -> Column:
    """Lower case, without marks on letters (by Unicode decomposition) and outer space, ß as ss; null is empty. Letters that only look
    like marked ones (ø, ł, đ) stay."""
    plain = F.translate(F.lower(F.trim(F.coalesce(text.cast("string"), F.lit("")))), *_marked())
    return F.replace(F.regexp_replace(plain, r"\p{M}", ""), F.lit("ß"), F.lit("ss"))
