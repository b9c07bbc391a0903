"""Rules that hold everywhere: closed time windows, null order, signed sentiment, entity keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(column: str | Column, start, end) -> Column:
    """Closed at both ends (F01): a message at the border counts in both neighbouring windows."""
    column = F.col(column) if isinstance(column, str) else column
    return (column >= F.lit(start)) & (column <= F.lit(end))


def optional(df: DataFrame, column: str, value) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def contains_text(column: str, search: str) -> Column:
    """Case-insensitive search (F03); % and _ of the search are wildcards."""
    return F.lower(F.coalesce(F.col(column), F.lit(""))).like(f"%{search.lower()}%")


def signed_sentiment() -> Column:
    """Difference of probabilities if there is one, else the score signed by the label."""
    label, score = F.lower(F.coalesce("sentiment_label", F.lit("neutral"))), F.coalesce("sentiment_score", F.lit(0.0))
    known = F.col("positive_prob").isNotNull() | F.col("negative_prob").isNotNull()
    return F.when(known, F.coalesce("positive_prob", F.lit(0.0)) - F.coalesce("negative_prob", F.lit(0.0))).when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)


def label_or_neutral() -> Column:
    """(F07)"""
    return F.lower(F.coalesce("sentiment_label", F.lit("neutral")))


def entity_key() -> Column:
    """(F08)"""
    return F.lower(F.coalesce("normalized_text", "entity_text"))


def entity_text() -> Column:
    """Display text of a group of mentions."""
    return F.coalesce(F.max("normalized_text"), F.min("entity_text"))


def mean(column: Column) -> Column:
    """An average that doesn't depend on the order of rows: sums are decimal."""
    return F.sum(column.cast("decimal(18,4)")).cast("double") / F.count(column)


def truncated(unit: str, column: str) -> Column:
    """date_trunc that keeps timestamps without time zone as they are."""
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def title_case(column: Column) -> Column:
    """Upper case after everything that is not a letter (X16), unlike initcap."""
    parts = F.regexp_extract_all(column, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def utc_time(value: Column) -> Column:
    """Time in UTC from ISO text; a space before an offset stands for the plus that a query string loses. Null if it is no time."""
    v = F.regexp_replace(F.trim(value), r"Z$", "+00:00")
    v = F.regexp_replace(F.regexp_replace(v, r" ([+-]\d{2}:?\d{2})$", "$1"), r" (\d{2}:\d{2})$", "+$1")
    offset = F.regexp_extract(v, r"([+-]\d{2}:?\d{2})$", 1)
    offset = F.when(F.length(v) > 19, offset).otherwise("")
    minutes = F.coalesce((F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int") * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(F.regexp_replace(offset, ":", ""), 4, 2).try_cast("int"))), F.lit(0))
    return v.substr(F.lit(1), F.length(v) - F.length(offset)).try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes)


def decoded_id(value: Column) -> Column:
    """(F16) Percent signs decoded twice at most; a plus stays a plus."""
    once = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    return once(once(value))


def shown_type(kind: Column) -> Column:
    """Entity type of the store as it is shown."""
    up = F.upper(F.coalesce(kind, F.lit("")))
    return F.when(up.isin("PERSON", "PER"), "PER").when(up.isin("ORG", "LOC"), up).otherwise("MISC")


def stored_type(kind: Column) -> Column:
    """Type to filter by; null stands for no filter."""
    up = F.upper(F.coalesce(kind, F.lit("")))
    return F.when(up == "PER", "PERSON").when(up.isin("ORG", "LOC"), up)
