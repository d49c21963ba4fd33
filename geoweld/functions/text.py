"""Strings, semantic nulls and small rules as column expressions."""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing. Fixed values.
NULL_TEXTS = ("", "nan", "none", "<na>", "null")


def semantic_null(text: Column) -> Column:
    """The trimmed text, null where it only says that there is none."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin(*NULL_TEXTS), trimmed)


def first_present(*columns: Column, default: Column | None = None) -> Column:
    found = [semantic_null(c.cast("string")) for c in columns]
    return F.coalesce(*found, *([] if default is None else [default]))


def normalized(text: Column) -> Column:
    return F.coalesce(F.lower(semantic_null(text)), F.lit(""))


def folded(text: Column) -> Column:
    """Lower case without accents, white space as single spaces."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def id_values(text: Column) -> Column:
    """The parts of an id list split at pipe, comma and semicolon, and the whole."""
    whole = F.trim(text)
    parts = F.filter(F.transform(F.split(whole, r"[|,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(whole != "", F.array_distinct(F.concat(F.array(whole), parts))).otherwise(F.array().cast("array<string>"))


@functools.lru_cache(1 << 14)
def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def _score(a: str | None, b: str | None) -> float:
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    return _ratio(a, b) if a and b else 0.0


def name_score(left: Column | str, right: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of the names in lower case; 0 if either is missing."""

    @F.pandas_udf(T.DoubleType())
    def scores(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_score(a, b) for a, b in zip(left, right, strict=True)], dtype=float)

    # told to be nondeterministic so that filters on it aren't pushed down, which would work it out twice
    return scores.asNondeterministic()(left, right)


def decay_weight(age_days: Column, half_life_days: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def retry_delay(attempt: Column, initial: float = 60.0, factor: float = 2.0, most: float = 3600.0) -> Column:
    return F.least(F.lit(most), initial * F.pow(F.lit(factor), attempt - 1))


def area_bucket(degrees: Column) -> Column:
    return F.when(degrees.isNull(), "unknown").when(degrees <= 0.05, "small").when(degrees <= 1.0, "medium").otherwise("large")


def remapped_height(height: Column, floor: float = 2.5, at_three: float = 3.2) -> Column:
    """Null stays; exactly 3 becomes at_three, below the floor 3, the rest is rounded to two places."""
    return F.when(height.isNull(), None).when(height == 3, at_three).when(height < floor, 3.0).otherwise(F.round(height, 2))
