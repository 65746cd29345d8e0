"""Token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrow.functions.text import utf16_length

#: A counter turns segments and the cached count into a column; None stands for the estimate.
Counter = Callable[[Column, Column], Column]


def segment_chars(segment: Column) -> Column:
    """Characters that count: a tool call's id and a result's tool name do not."""
    content = F.coalesce(utf16_length(segment["content"]), F.lit(0))
    return (
        content
        + F.when(segment["kind"] == "tool_use", F.coalesce(utf16_length(segment["tool_name"]), F.lit(0)))
        .when(segment["kind"] == "tool_result", F.coalesce(utf16_length(segment["tool_call_id"]), F.lit(0)))
        .otherwise(0)
    ).cast("long")


def message_chars(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("long"), lambda total, s: total + segment_chars(s))


def estimate(chars: Column) -> Column:
    return (F.ceil(chars / F.lit(4.0)) + 4).cast("long")


def count_segments(segments: Column, cached: Column) -> Column:
    """What the counter itself gives: a cached count only if it is over 0."""
    return F.when(cached > 0, cached.cast("long")).otherwise(estimate(message_chars(segments)))


def message_tokens(segments: Column, cached: Column, counter: Counter = count_segments) -> Column:
    """What the log takes a message for: a cached count if there is one, 0 included."""
    return F.coalesce(cached.cast("long"), counter(segments, cached))
