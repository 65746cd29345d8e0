"""Token economy reports over turn tables (session, turn, before, after, outcome, compacted, input, output, total)."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percent(part, whole):
    return F.when(whole != 0, part * F.lit(100.0) / whole)


def savings(turns: DataFrame) -> DataFrame:
    """Totals before and after, what was reported, and what was saved, over all turns and in the last one."""
    sums = turns.groupBy("session").agg(
        F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("input").alias("input"), F.count("*").alias("turns"),
        F.max_by(F.struct("before", "after"), "turn").alias("last"),
    )
    saved, final = F.col("before") - F.col("after"), F.col("last.before") - F.col("last.after")
    return sums.select(
        "session", "turns", "before", "after", "input", saved.alias("saved"), percent(saved, F.col("before")).alias("saved_percent"),
        final.alias("last_saved"), percent(final, F.col("last.before")).alias("last_saved_percent"),
    )


def outcome_distribution(rows: DataFrame, *by: str) -> DataFrame:
    """How often each outcome occurs, and its share of the group in percent."""
    counts = rows.groupBy(*by, "outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def invariant_violations(turns: DataFrame, window_tokens: DataFrame | int | None = None) -> DataFrame:
    """session, turn, invariant, observed, expected and severity of each violation, severe ones first in each session.

    window_tokens: one number, or a table of session and window_tokens. The first invariant may fail for a good reason: a corrected
    estimate can fall without any change to the history.
    """
    order = Window.partitionBy("session").orderBy("turn")
    by_session = isinstance(window_tokens, DataFrame)
    rows = turns.join(window_tokens, "session", "left") if by_session else turns.withColumn("window_tokens", F.lit(window_tokens).cast("bigint"))
    rows = rows.withColumn("p_before", F.lag("before").over(order)).withColumn("p_compacted", F.lag("compacted").over(order))
    gap = F.abs(F.col("input") - F.col("after"))
    checks = [
        ("history_shrank", 1, F.col("before") < F.col("p_before"), "before", F.col("p_before")),
        ("over_window", 0, F.col("input") > F.col("window_tokens"), "input", F.col("window_tokens")),
        ("estimate_off", 2, gap * 10 > F.col("after"), "input", F.col("after")),
        ("compacted_fell", 1, F.col("compacted") < F.col("p_compacted"), "compacted", F.col("p_compacted")),
        ("compacted_jumped", 3, F.col("compacted") - F.col("p_compacted") > 20, "compacted", F.col("p_compacted")),
        ("compaction_useless", 1, (F.col("outcome") == "Compacted") & (F.col("after") >= F.col("before")), "after", F.col("before")),
        ("reported_far_below", 2, (F.col("after") - F.col("input")) * 100 > F.col("after") * 15, "input", F.col("after")),
    ]
    found = F.array_compact(F.array(*(
        F.when(broken, F.struct(F.lit(name).alias("invariant"), F.col(seen).cast("bigint").alias("observed"), expected.cast("bigint").alias("expected"), F.lit(severity).alias("severity")))
        for name, severity, broken, seen, expected in checks
    )))
    return rows.select("session", "turn", F.inline(found))


def session_summary(turns: DataFrame, headers: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Model, budget, turns, duration in seconds (times: session, ts) and savings of each session."""
    out = savings(turns).join(headers, "session", "left")
    if times is not None:
        span = times.groupBy("session").agg((F.max("ts").cast("double") - F.min("ts").cast("double")).alias("seconds"))
        out = out.join(span, "session", "left")
    return out


def ranked(violations: DataFrame) -> DataFrame:
    order = Window.partitionBy("session").orderBy("severity", "turn", "invariant")
    return violations.withColumn("rank", F.row_number().over(order))


def budget_used(tokens, window_tokens):
    """Percent of the window in use; null for a window of 0."""
    return percent(tokens, window_tokens)


def status_line(tokens, window_tokens):
    return F.concat(F.format_number(tokens, 0), F.lit(" / "), F.format_number(window_tokens, 0), F.lit(" ("), F.format_number(F.coalesce(budget_used(tokens, window_tokens), F.lit(0.0)), 1), F.lit("%)"))
