"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(text: Column) -> Column:
    """The number that a text is, 0 if it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def genus(scientific: Column) -> Column:
    """The first word in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.element_at(F.split(F.trim(scientific), r"\s+"), 1), F.lit("")))


def name_words(common: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.coalesce(common, F.lit("")))), r"\s+"), lambda w: w != "")


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def rating_kept(rating: Column, least: float) -> Column:
    """Unrated rows (0) stay; rated ones must reach ``least``."""
    return ~((F.lit(least) > 0) & (rating > 0) & (rating < least))
