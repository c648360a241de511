"""Number expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.text import either
from leadloom.functions.vocabulary import FOLLOWER_WORDS

_FOLLOWERS = (r"(?iU)([0-9]{1,3}(?:[.,][0-9]{1,3})?|[0-9]{1,9})\s*([kmb]?)\s*(?:" + either(FOLLOWER_WORDS) + ")")


def half_even(value: Column) -> Column:
    """Round to a whole number, halves to the even side."""
    return F.rint(value).cast("int")


def follower_count(text: Column) -> Column:
    """Followers stated in a text, NULL when none are. With K, M or B a comma is a decimal point."""
    raw = F.regexp_extract(text, _FOLLOWERS, 1)
    suffix = F.lower(F.regexp_extract(text, _FOLLOWERS, 2))
    number = F.when(suffix == "", F.replace(raw, F.lit(","), F.lit(""))).otherwise(
        F.replace(raw, F.lit(","), F.lit("."))).try_cast("double")
    scale = (F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0))
    return (number * scale).cast("long")


def follower_label(count: Column) -> Column:
    def short(scale: float, unit: str) -> Column:
        return F.format_string(f"%.1f{unit}", F.bround(count / F.lit(scale), 1))
    return (F.when(count.isNull(), "unknown").when(count >= 1_000_000, short(1e6, "M"))
            .when(count >= 1_000, short(1e3, "K")).otherwise(count.cast("string")))


def share(total: Column, parts: int, index: Column) -> Column:
    """Exact whole-number split: the first ``total % parts`` shares get one more."""
    return (F.floor(total / F.lit(parts)) + F.when(index < total % F.lit(parts), 1).otherwise(0)).cast("long")
