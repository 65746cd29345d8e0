"""Prepared messages in the forms that model providers take, and their responses as segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.text import is_blank
from windrow.schema import text_segment, tool_use


def of_kind(segments: Column, kind: str) -> Column:
    return F.filter(segments, lambda s: s["kind"] == kind)


def first_text(segments: Column) -> Column:
    """The first text, empty if there is none. Later texts are budgeted but not sent."""
    return F.coalesce(F.get(of_kind(segments, "text"), F.lit(0))["content"], F.lit(""))


def openai_messages(messages: DataFrame) -> DataFrame:
    """conv_id, msg_idx, role, content, tool_calls (array of id, name, arguments) and tool_call_id; tool messages without a result are left out."""
    result = F.get(of_kind(F.col("segments"), "tool_result"), F.lit(0))
    calls = F.transform(of_kind(F.col("segments"), "tool_use"), lambda s: F.struct(s["tool_call_id"].alias("id"), s["tool_name"].alias("name"), s["content"].alias("arguments")))
    is_tool = F.col("role") == "Tool"
    return messages.filter(~is_tool | result.isNotNull()).select(
        "conv_id", "msg_idx", F.when(F.col("role") == "Model", "assistant").otherwise(F.lower("role")).alias("role"),
        F.when(is_tool, result["content"]).otherwise(first_text(F.col("segments"))).alias("content"),
        F.when(F.col("role") == "Model", calls).alias("tool_calls"), F.when(is_tool, result["tool_call_id"]).alias("tool_call_id"),
    )


BLOCK = "struct<type:string,text:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string>"


def _block(kind: str, **values: Column) -> Column:
    names = ("text", "id", "name", "input", "tool_use_id", "content")
    return F.struct(F.lit(kind).alias("type"), *(values.get(n, F.lit(None)).alias(n) for n in names)).cast(BLOCK)


def anthropic_messages(messages: DataFrame) -> DataFrame:
    """conv_id, msg_idx, role, blocks and error for all but system messages.

    Tool results come from the user. Arguments must be a JSON object; a message with others has the
    error `tool_arguments_not_an_object` and a null input there.
    """
    segments = F.col("segments")
    text = first_text(segments)
    result = F.get(of_kind(segments, "tool_result"), F.lit(0))
    inputs = lambda s: F.from_json(s["content"], "map<string,string>")
    is_object = lambda s: s["content"].rlike(r"^\s*\{") & inputs(s).isNotNull()
    calls = F.transform(of_kind(segments, "tool_use"), lambda s: _block("tool_use", id=s["tool_call_id"], name=s["tool_name"], input=F.when(is_object(s), inputs(s))))
    said = F.when(is_blank(text), F.array().cast(f"array<{BLOCK}>")).otherwise(F.array(_block("text", text=text)))
    blocks = (
        F.when(F.col("role") == "User", F.array(_block("text", text=text)))
        .when(F.col("role") == "Model", F.concat(said, calls))
        .otherwise(F.array(_block("tool_result", tool_use_id=result["tool_call_id"], content=result["content"])))
    )
    bad = F.exists(of_kind(segments, "tool_use"), lambda s: ~F.coalesce(is_object(s), F.lit(False)))
    return messages.filter((F.col("role") != "System") & ((F.col("role") != "Tool") | result.isNotNull())).select(
        "conv_id", "msg_idx", F.when(F.col("role") == "Model", "assistant").otherwise("user").alias("role"), blocks.alias("blocks"),
        F.when((F.col("role") == "Model") & bad, "tool_arguments_not_an_object").alias("error"),
    )


def anthropic_system(messages: DataFrame) -> DataFrame:
    """conv_id and the non-blank first texts of its system messages in order; conversations without one are left out."""
    texts = messages.filter("role = 'System'").select("conv_id", "msg_idx", first_text(F.col("segments")).alias("text")).filter(~is_blank(F.col("text")))
    return texts.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "text"))), lambda t: t["text"]).alias("system"))


def response_segments(texts: Column, calls: Column) -> Column:
    """Segments of a response: its non-blank texts, then its tool calls (structs of id, name, arguments; blank arguments are `{}`)."""
    said = F.transform(F.filter(texts, lambda t: ~is_blank(t)), text_segment)
    used = F.transform(calls, lambda c: tool_use(c["id"], c["name"], F.when(is_blank(c["arguments"]), F.lit("{}")).otherwise(c["arguments"])))
    return F.concat(said, used)


def input_tokens(usage: Column) -> Column:
    """The reported input tokens, null where a response has no usage."""
    return F.when(usage.isNotNull(), usage["input_tokens"])
