"""The one two-clock predicate: what was known when, and what was in force when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(recorded_at: Column, known_at: Column) -> Column:
    return recorded_at <= known_at


def effective(recorded_at: Column, valid_from: Column, valid_to: Column, on: Column) -> Column:
    """Half-open; an absent start is the day of recording, an absent end is open."""
    return (F.coalesce(valid_from, F.to_date(recorded_at)) <= on) & (valid_to.isNull() | (on < valid_to))
