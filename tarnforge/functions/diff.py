"""Differences between versions of a content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnforge.functions.text import line_count


def change_percent(old: Column, new: Column) -> Column:
    """Change of length in per cent of the old one; 100 if that is empty."""
    return F.coalesce(F.try_divide(100.0 * (F.length(new) - F.length(old)), F.length(old)), F.lit(100.0))


def content_diff(old: Column, new: Column) -> Column:
    """Struct of lengths, lines, their changes, the percentage, and whether it is above 10 either way."""
    change = change_percent(old, new)
    return F.struct(
        F.length(old).alias("old_length"),
        F.length(new).alias("new_length"),
        (F.length(new) - F.length(old)).alias("length_change"),
        line_count(old).alias("old_lines"),
        line_count(new).alias("new_lines"),
        (line_count(new) - line_count(old)).alias("line_change"),
        change.alias("change_percentage"),
        (F.abs(change) > 10).alias("significant_change"),
    )


def significant(old: Column, new: Column, percent: float = 10.0) -> Column:
    """Whether length changed by at least ``percent``; unlike ``content_diff``, the bound itself counts."""
    return F.abs(change_percent(old, new)) >= percent
