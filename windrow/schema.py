"""The message log: one row for each message of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.text import is_blank

SEGMENT = "struct<kind:string,tool_call_id:string,tool_name:string,content:string>"
MESSAGES = f"conv_id bigint, msg_idx int, role string, state string, is_pinned boolean, ts timestamp, turn int, token_count int, segments array<{SEGMENT}>"
ROLES = ("System", "User", "Model", "Tool")


def text_segment(content: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_name"), content.alias("content"))


def tool_use(call_id: Column, name: Column, arguments: Column) -> Column:
    return F.struct(F.lit("tool_use").alias("kind"), call_id.alias("tool_call_id"), name.alias("tool_name"), arguments.alias("content"))


def tool_result(call_id: Column, name: Column, content: Column) -> Column:
    return F.struct(F.lit("tool_result").alias("kind"), call_id.alias("tool_call_id"), name.alias("tool_name"), content.alias("content"))


def violations(messages: DataFrame) -> DataFrame:
    """conv_id, msg_idx and rule for each rule that a message breaks."""
    segment_rules = [
        ("text_blank", lambda s: (s["kind"] == "text") & is_blank(s["content"])),
        ("tool_call_id_blank", lambda s: (s["kind"] != "text") & is_blank(s["tool_call_id"])),
        ("tool_name_blank", lambda s: (s["kind"] != "text") & is_blank(s["tool_name"])),
        ("tool_arguments_blank", lambda s: (s["kind"] == "tool_use") & is_blank(s["content"])),
        ("tool_result_null", lambda s: (s["kind"] == "tool_result") & s["content"].isNull()),
        ("kind_unknown", lambda s: ~F.coalesce(s["kind"].isin("text", "tool_use", "tool_result"), F.lit(False))),
    ]
    rules = [
        F.when(F.col("segments").isNull() | (F.size("segments") < 1), F.lit("no_segments")),
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), F.lit("role_unknown")),
        *(F.when(F.exists("segments", rule), F.lit(name)) for name, rule in segment_rules),
    ]
    return messages.select("conv_id", "msg_idx", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
