"""Preparing conversations under a token budget: log in; results, messages and events out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.tokens import Counter, count_segments, message_tokens
from windrow.operators.compaction import KEYS, drop_oldest, mask, masked_segments, measured, preserve, protect, totals, turn_groups
from windrow.plans.budget import BudgetError, Profile

#: A strategy turns narrow rows into rows with is_protected, is_masked and cost.
Strategy = Callable[[DataFrame], DataFrame]


def sliding_window(rows: DataFrame) -> DataFrame:
    return mask(protect(rows))


def _checked(strategy: Strategy, rows: DataFrame) -> DataFrame:
    """The strategy's rows; with the error StrategyChangedRows where a conversation with pinned messages has not the rows it had.

    Pinned messages go back to their places among the others, so those have to keep their number and indexes.
    """
    whole = Window.partitionBy(*KEYS)
    place = F.sum(F.xxhash64("msg_idx").cast("decimal(38,0)"))
    given = rows.withColumn("_given", place.over(whole)).withColumn("_pinned", F.max("is_pinned").over(whole))
    done = strategy(given)
    changed = F.col("_pinned") & (place.over(whole) != F.col("_given"))
    return done.withColumn("error", F.coalesce("error", F.when(changed, "StrategyChangedRows"))).drop("_given", "_pinned")


@dataclass(frozen=True)
class Prepared:
    """rows: every message with all decisions; results: one row for each profile and conversation."""

    rows: DataFrame
    results: DataFrame
    template: str
    source: DataFrame

    def messages(self) -> DataFrame:
        """The prepared messages with their contents, one list for each profile and conversation.

        A conversation with a pinned overflow has none.
        """
        kept = self.rows.filter("error IS NULL AND NOT is_dropped").select(*KEYS, "msg_idx", "is_masked", F.col("cost").alias("prepared_tokens"), F.when(F.col("is_masked"), F.col("names")).alias("names"))
        full = self.source.join(kept, ["conv_id", "msg_idx"])
        masked = masked_segments(self.template, F.col("segments"), F.col("names"))
        return full.select(
            *KEYS, "msg_idx", "role", F.when(F.col("is_masked"), "Masked").otherwise(F.col("state")).alias("state"), "is_pinned", "turn", "prepared_tokens",
            F.when(F.col("is_masked"), masked).otherwise(F.col("segments")).alias("segments"),
        )

    def events(self) -> DataFrame:
        """What an observer is told: one row where masking or the emergency drop changed something.

        A normal event counts the unpinned messages without the anchor on both sides. An emergency
        event's `after` is the final total with pinned messages and anchor.
        """
        emergency = F.col("dropped") > 0
        return self.results.filter("error IS NULL AND (dropped > 0 OR masked > 0)").select(
            *KEYS, F.when(emergency, "Emergency").otherwise("Normal").alias("trigger_kind"), F.col("strategy_before").alias("tokens_before"),
            F.when(emergency, F.col("tokens_after")).otherwise(F.col("strategy_after")).alias("tokens_after"),
            F.when(emergency, F.col("compacted")).otherwise(F.col("masked")).alias("affected"), "dropped", F.lit("SlidingWindowStrategy").alias("strategy"),
        )


def prepare(
    messages: DataFrame, profiles: Sequence[Profile], correction: DataFrame | None = None, strategy: Strategy = sliding_window, counter: Counter = count_segments, strict_floor: bool = False,
) -> Prepared:
    """Prepare every conversation of a log under every profile.

    Conversations below the trigger skip the strategy. All windows share their keys, so the narrow rows
    are exchanged once. The profiles must share one placeholder.
    """
    templates = {p.window.placeholder for p in profiles}
    if len(templates) != 1:
        raise BudgetError("the profiles of one run share one placeholder")
    template = templates.pop()
    narrow = measured(messages, template, counter)
    rows = totals(narrow.select("*", F.inline(F.array(*(p.column() for p in profiles)))), correction)
    rows = rows.withColumn("error", F.when(F.col("pinned") > F.col("max_tokens"), "PinnedTokenBudgetExceeded"))
    rows = rows.withColumn("is_ready", F.col("total") < F.col("trigger"))
    if strategy is not sliding_window:
        rows = _checked(strategy, rows)
    else:
        rows = strategy(rows)
    idle = F.col("is_ready") | F.col("error").isNotNull()
    rows = rows.withColumn("is_masked", F.col("is_masked") & ~idle).withColumn("cost", F.when(idle, F.col("tokens")).otherwise(F.col("cost")))
    rows = drop_oldest(turn_groups(preserve(rows, strict_floor)))
    rows = rows.withColumn("is_dropped", F.col("is_dropped") & ~idle)
    return Prepared(rows, outcomes(rows), template, messages)


def outcomes(rows: DataFrame) -> DataFrame:
    """One row for each profile and conversation.

    compacted counts newly masked and dropped messages, so one that is masked and then dropped counts
    twice.
    """
    unpinned = lambda column: F.coalesce(F.sum(F.when(~F.col("is_pinned"), F.col(column))), F.lit(0))
    one = lambda column: F.first(column).alias(column)
    out = rows.groupBy(*KEYS).agg(
        one("max_tokens"), one("tolerance"), one("error"), one("is_ready"), F.first("total").alias("tokens_before"), one("correction"),
        F.count_if(F.col("is_masked") & (F.col("state") == "Original")).alias("masked"), F.count_if("is_dropped").alias("dropped"),
        F.coalesce(F.sum(F.when(~F.col("is_dropped"), F.col("cost"))), F.lit(0)).alias("raw_final"),
        unpinned("tokens").alias("strategy_before"), unpinned("cost").alias("strategy_after"),
    )
    return labelled(out)


def labelled(out: DataFrame) -> DataFrame:
    """Results with final tokens, outcome and reason."""
    out = out.withColumn("tokens_after", F.col("raw_final") + F.col("correction")).withColumn("compacted", F.col("masked") + F.col("dropped"))
    most = F.col("max_tokens") + F.col("tolerance")
    out = out.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), F.lit(None).cast("string")).when(F.col("is_ready"), "Ready")
        .when(F.col("tokens_after") <= most, F.when(F.col("compacted") > 0, "Compacted").otherwise("Ready"))
        .otherwise(F.when(F.col("compacted") == 0, "ContextExhausted").otherwise("Degraded")),
    )
    return out.withColumn("reason", degradation_reason(out))


def degradation_reason(results: DataFrame):
    """Both templates are fixed values."""
    most = F.col("max_tokens") + F.col("tolerance")
    exhausted = F.format_string("A single message or structural content exceeds the budget (%d tokens > %d max). Compaction is impossible.", F.col("tokens_after"), most)
    degraded = F.format_string("Compaction reduced content but still exceeds budget (%d tokens > %d max). %d messages were compacted but insufficient.", F.col("tokens_after"), most, F.col("compacted"))
    return F.when(F.col("outcome") == "ContextExhausted", exhausted).when(F.col("outcome") == "Degraded", degraded)


def prefixes(messages: DataFrame, counter: Counter = count_segments) -> DataFrame:
    """Every prepare point as a log of its own: for each model row the messages before it. conv_id is a struct of conv_id and point.

    The rows are narrow copies with their counts cached. A conversation of n messages makes up to n * n / 2
    rows, so this is for bounded conversations; `points.prepare_points` has the same results without copies.
    """
    points = messages.filter("role = 'Model'").select(F.col("conv_id").alias("c"), F.col("msg_idx").alias("point"))
    cached = messages.withColumn("token_count", message_tokens(F.col("segments"), F.col("token_count"), counter).cast("int"))
    copies = cached.join(points, (F.col("conv_id") == F.col("c")) & (F.col("msg_idx") < F.col("point"))).drop("c")
    return copies.withColumn("conv_id", F.struct("conv_id", "point")).drop("point")
