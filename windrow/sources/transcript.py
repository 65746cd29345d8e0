"""Session transcripts: events out as Markdown, Markdown in as events and turns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from windrow.functions.text import is_blank, truncate_event

#: Fixed values of the format: how much of a content is written.
RESULT_CAP, CONTENT_CAP, ANSWER_CAP, FAILURE_CAP = 200, 400, 600, 1000

EVENTS = (
    "session string, seq bigint, kind string, ts timestamp, turn int, exchange int, content string, workspace string, workspace_path string, model string, "
    "window_tokens int, soft_ratio double, hard_ratio double, window_size int, label string, tokens_before int, tokens_after int, outcome string, compacted int, "
    "dropped int, reason string, input_tokens int, output_tokens int, total_tokens int, tool_name string, arguments string, duration string, failure_type string, stack string"
)
TERMINAL = ("session_ended", "session_cancelled", "session_failed")
#: After these nothing more is written.
STOPPED = ("session_cancelled", "session_failed")


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("n/a"))


def _stamp() -> Column:
    return F.concat(F.lit("- TimestampUtc: "), F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def _fence(language: str, body: Column) -> list:
    return [f"```{language}", body, "```"]


def _lines(*parts) -> Column:
    return F.concat(F.array_join(F.array(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), "\n"), F.lit("\n"))


def _head(text: str, *numbers: Column) -> Column:
    return F.concat(F.lit(text), *numbers) if numbers else F.lit(text)


@F.pandas_udf(StringType())
def _indented(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return text

    return texts.map(one)


def pretty_json(text: Column) -> Column:
    """Indented JSON, `{}` for a blank text, the text itself if it is no JSON."""
    return F.when(is_blank(text), "{}").otherwise(_indented(text))


def render(events: DataFrame) -> DataFrame:
    """session, seq and text: the events as the transcript has them."""
    nth = (F.col("exchange") + 1).cast("string")
    turn = F.concat(F.lit(" (turn "), F.col("turn"), F.lit(")"))
    content = lambda cap: truncate_event(F.col("content"), cap)
    field = lambda name, column: F.concat(F.lit(f"- {name}: "), _value(column))
    budget = F.concat(
        F.lit("- Budget: `ContextWindowTokens="), "window_tokens", F.lit(", SoftThresholdRatio="), F.col("soft_ratio").cast("string"),
        F.lit(", HardThresholdRatio="), F.col("hard_ratio").cast("string"), F.lit(", WindowSize="), "window_size", F.lit("`"),
    )
    quoted = lambda name, column: F.concat(F.lit(f"- {name}: `"), F.col(column), F.lit("`"))
    dropped = F.when(F.col("dropped") > 0, F.concat(F.lit("- MessagesDropped: "), F.col("dropped"), F.lit("\n"))).otherwise("")
    failure = F.concat(F.lit("Type: "), "failure_type", F.lit("\nMessage: "), "content", F.lit("\nStackTrace:\n"), F.coalesce("stack", F.lit("")))
    shown = {
        "session_started": _lines("# Session Transcript", "", _stamp(), quoted("Workspace", "workspace"), quoted("WorkspacePath", "workspace_path"), quoted("Model", "model"), budget, quoted("Session", "label"), "", "## Session Started", ""),
        "user_prompt": _lines("", _head("## User Message ", nth), "", _stamp(), "", *_fence("text", content(CONTENT_CAP))),
        "prepared": _lines("", _head("## PrepareResult", turn), "", _stamp(), field("TokensBeforeCompaction", "tokens_before"), field("TokensAfterCompaction", "tokens_after"), field("Outcome", "outcome"), field("MessagesCompacted", "compacted"), F.concat(dropped, field("DegradationReason", "reason"))),
        "model_requested": _lines("", _head("## Model request", turn), "", _stamp(), "", *_fence("json", content(CONTENT_CAP))),
        "model_responded": _lines("", _head("## Model response", turn), "", _stamp(), field("InputTokensReported", "input_tokens"), field("OutputTokensReported", "output_tokens"), field("TotalTokensReported", "total_tokens"), "", "### Assistant Content", "", *_fence("text", content(CONTENT_CAP)), "", "### Tool Calls Issued", "", *_fence("json", truncate_event(F.col("arguments"), CONTENT_CAP))),
        "tool_called": _lines("", _head("### Tool call: ", F.col("tool_name")), "", _stamp(), "#### Arguments", "", *_fence("json", truncate_event(pretty_json(F.col("arguments")), CONTENT_CAP))),
        "tool_completed": _lines("", F.regexp_replace(_stamp(), "^- TimestampUtc", "- CompletedUtc"), field("Duration", "duration"), "#### Result", "", *_fence("text", content(RESULT_CAP))),
        "assistant_reply": _lines("", _head("## Assistant Reply ", nth), "", _stamp(), "", *_fence("text", content(ANSWER_CAP))),
        "exchange_outcome": _lines("", _head("### Exchange Outcome ", nth), "", _stamp(), field("Outcome", "outcome"), field("Details", "reason")),
        "session_ended": _lines("", "## Summary", "", _stamp(), field("TotalTurns", "turn"), field("TotalReportedTokens", "total_tokens"), field("TerminalOutcome", "outcome")),
        "session_cancelled": _lines("", "## Session Cancelled", "", _stamp(), field("TurnIndex", "turn"), field("PartialReason", "reason")),
        "session_failed": _lines("", "## Session Failed", "", _stamp(), "", *_fence("text", truncate_event(failure, FAILURE_CAP))),
    }
    text = None
    for kind, column in shown.items():
        text = F.when(F.col("kind") == kind, column) if text is None else text.when(F.col("kind") == kind, column)
    return events.select("session", "seq", text.alias("text"))


def transcripts(events: DataFrame) -> DataFrame:
    """session and text: the whole transcript of each session. What follows a cancelled or failed event is left out."""
    end = F.min(F.when(F.col("kind").isin(*STOPPED), F.col("seq"))).over(Window.partitionBy("session"))
    live = events.withColumn("end", end).filter(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    whole = render(live).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return whole.select("session", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def segments_json(segments: Column) -> Column:
    """Segments as the transcript's JSON has them; long tool results are cut."""
    kind = lambda s: F.when(s["kind"] == "tool_use", "ToolUseContent").when(s["kind"] == "tool_result", "ToolResultContent").otherwise("TextContent")
    body = lambda s: F.when(s["kind"] == "tool_result", truncate_event(s["content"], RESULT_CAP)).otherwise(s["content"])
    return F.to_json(F.transform(segments, lambda s: F.struct(kind(s).alias("type"), s["tool_call_id"].alias("toolCallId"), s["tool_name"].alias("toolName"), body(s).alias("content"))))


def blocks(lines: DataFrame) -> DataFrame:
    """Lines (session, line_no, line) that stand before the first code fence of their `## ` block, with the block's number.

    Contents stand in fences but may hold fences and headers themselves. So a header counts only where a
    time stamp follows two lines later, as the writer puts it, and nothing after a block's first fence
    is looked at: all fields come before it.
    """
    order = Window.partitionBy("session").orderBy("line_no")
    stamped = F.coalesce(F.lead("line", 2).over(order).startswith("- TimestampUtc: "), F.lit(False))
    starts = F.col("line").startswith("## ") & (stamped | (F.col("line") == "## Session Started"))
    rows = lines.withColumn("starts", starts.cast("int"))
    rows = rows.withColumn("block", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
    in_block = Window.partitionBy("session", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(F.col("line").startswith("```").cast("int")).over(in_block)
    return rows.withColumn("fences", fences).filter("fences = 0").drop("fences")


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double") if hasattr(text, "try_cast") else F.regexp_replace(text, ",", ".").cast("double")


def header(lines: DataFrame) -> DataFrame:
    """session, model, window_tokens, soft_ratio and hard_ratio. Values may stand in backticks, ratios may have a decimal comma."""
    top = blocks(lines).filter("block = 0")
    pick = lambda pattern: F.max(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    return top.groupBy("session").agg(
        pick(r"^- Model: `?([^`]*)`?").alias("model"), pick(r"ContextWindowTokens=(\d+)").cast("bigint").alias("window_tokens"),
        _number(pick(r"SoftThresholdRatio=(\d+(?:[.,]\d+)?)")).alias("soft_ratio"), _number(pick(r"HardThresholdRatio=(\d+(?:[.,]\d+)?)")).alias("hard_ratio"),
    )


def turn_table(lines: DataFrame) -> DataFrame:
    """One row for each prepared turn; reported counts are null where no response follows."""
    body = blocks(lines).filter("block > 0")
    kind = F.max(F.when(F.col("line").startswith("## PrepareResult"), "prepare").when(F.col("line").startswith("## Model response"), "response"))
    turn = F.max(F.nullif(F.regexp_extract("line", r"^## (?:PrepareResult|Model response) \(turn (\d+)\)", 1), F.lit(""))).cast("int")
    value = lambda name: F.max(F.when(F.col("line").startswith(f"- {name}: "), F.substring("line", len(name) + 5, 2**31 - 1)))
    number = lambda name: F.nullif(value(name), F.lit("n/a")).cast("bigint")
    one = body.groupBy("session", "block").agg(
        kind.alias("kind"), turn.alias("turn"), number("TokensBeforeCompaction").alias("before"), number("TokensAfterCompaction").alias("after"), value("Outcome").alias("outcome"),
        number("MessagesCompacted").alias("compacted"), number("InputTokensReported").alias("input"), number("OutputTokensReported").alias("output"), number("TotalTokensReported").alias("total"),
    )
    of = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name))).alias(name)
    both = one.filter("turn IS NOT NULL").groupBy("session", "turn").agg(
        F.count_if(F.col("kind") == "prepare").alias("prepares"), *(of("prepare", n) for n in ("before", "after", "outcome", "compacted")), *(of("response", n) for n in ("input", "output", "total"))
    )
    return both.filter("prepares > 0").drop("prepares")


def session_totals(turns: DataFrame) -> DataFrame:
    """Turns and tokens before, after and reported of each session as they run up."""
    so_far = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("session", "turn", F.count("*").over(so_far).alias("turns"), F.sum("before").over(so_far).alias("before"), F.sum("after").over(so_far).alias("after"), F.sum("total").over(so_far).alias("reported"))


def status(events: DataFrame) -> DataFrame:
    """session, seq, tokens_after and the window size of the session's start event, carried to each prepared event."""
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select("session", "seq", "kind", "tokens_after", F.last("window_tokens", ignorenulls=True).over(so_far).alias("window_tokens"))
    return rows.filter("kind = 'prepared'").drop("kind")


def notices(events: DataFrame) -> DataFrame:
    """session, seq, title, notice and shown for each model response and session end: what a reader is told, and the text to show at once.

    arguments holds a response's tool calls as a JSON array. A response without any is an answer, which is
    shown when it is complete. label names the session's transcript: a session that its user ended is told where it
    is; any other end is a warning with a title and the transcript's name in a second line.
    """
    calls = F.coalesce(F.json_array_length("arguments"), F.lit(0))
    response, blank = F.col("kind") == "model_responded", is_blank(F.col("content"))
    number = lambda text, n: F.concat(F.lit(text), n.cast("string"), F.lit(" tool call(s)."))
    ended, by_user, log = F.col("kind") == "session_ended", F.coalesce(F.col("outcome") == "EndedByUser", F.lit(False)), _value("label")
    # fixed values: the texts of the notices
    notice = (
        F.when(response & (calls > 0) & blank, number("Model issuing ", calls)).when(response & (calls > 0), number("Model responded and requested ", calls))
        .when(ended & by_user, F.concat(F.lit("Session ended. Transcript saved to "), log))
        .when(ended, F.concat(F.col("outcome"), F.lit(". Total turns: "), F.col("turn"), F.lit(". Total tokens: "), _value("total_tokens"), F.lit(".\nSee session log: "), log))
    )
    title = F.when(ended & ~by_user, "Session Ended")
    shown = F.when(response & (calls > 0) & ~blank, F.col("content"))
    return events.filter(F.col("kind").isin("model_responded", "session_ended")).select("session", "seq", title.alias("title"), notice.alias("notice"), shown.alias("shown"))
