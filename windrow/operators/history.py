"""Building and re-indexing message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.schema import text_segment, tool_result, tool_use


def stamp_turns(messages: DataFrame) -> DataFrame:
    """turn for a log in which the context is prepared once before each model reply: the model rows so far."""
    so_far = Window.partitionBy("conv_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.sum(F.when(F.col("role") == "Model", 1).otherwise(0)).over(so_far).cast("int"))


def stamp_turns_from_log(log: DataFrame) -> DataFrame:
    """turn for a log with explicit prepares: rows conv_id, seq, kind (`append` or `prepare`).

    A prepare raises the turn only if something was appended since the last one; appended rows get the
    turn of their moment. Prepares are left out of the result.
    """
    order = Window.partitionBy("conv_id").orderBy("seq")
    bumps = (F.col("kind") == "prepare") & (F.lag("kind").over(order) == "append")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("turn", F.sum(F.coalesce(bumps, F.lit(False)).cast("int")).over(so_far).cast("int")).filter("kind = 'append'").drop("kind")


def from_conversations(conversations: DataFrame, pages: DataFrame) -> DataFrame:
    """The log of recorded conversations, in which each assistant row calls a tool that fetches a page.

    conversations: conv_id, turn, role, text; pages: page_id, html. System rows are pinned.
    """
    n_pages = pages.count()
    source = conversations.select(
        "conv_id", F.col("turn").alias("at"), F.lit(0).alias("part"),
        F.when(F.col("role") == "system", "System").when(F.col("role") == "user", "User").otherwise("Model").alias("role"), "text",
    )
    call = F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("at"))
    source = source.withColumn("page", F.when(F.col("role") == "Model", (F.col("conv_id") * 31 + F.col("at")) % max(n_pages, 1)))
    arguments = F.concat(F.lit('{"page_id":'), F.col("page"), F.lit("}"))
    said = F.when(F.col("role") == "Model", F.array(text_segment(F.col("text")), tool_use(call, F.lit("web_fetch"), arguments))).otherwise(F.array(text_segment(F.col("text"))))
    rows = source.select("conv_id", "at", "part", "role", said.alias("segments"))
    html = pages.select(F.col("page_id").alias("page"), "html")
    fetched = source.filter("page IS NOT NULL").join(html, "page").select(
        "conv_id", "at", F.lit(1).alias("part"), F.lit("Tool").alias("role"), F.array(tool_result(call, F.lit("web_fetch"), F.col("html"))).alias("segments")
    )
    order = Window.partitionBy("conv_id").orderBy("at", "part")
    log = rows.unionByName(fetched).select(
        "conv_id", (F.row_number().over(order) - 1).alias("msg_idx"), "role", F.lit("Original").alias("state"), (F.col("role") == "System").alias("is_pinned"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("int").alias("token_count"), "segments",
    )
    return stamp_turns(log)


def reindex(messages: DataFrame, *order: str) -> DataFrame:
    """msg_idx anew, from 0, in the given order."""
    return messages.withColumn("msg_idx", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)


def append(messages: DataFrame, appended: DataFrame) -> DataFrame:
    """appended: conv_id, seq and the message columns but msg_idx; its rows follow the log in the order of seq.

    An appended row takes the turn it carries.
    """
    both = messages.withColumn("seq", F.lit(-1).cast("long")).unionByName(appended.withColumn("msg_idx", F.lit(2**31 - 1)).withColumn("seq", F.col("seq").cast("long")))
    return reindex(both, "seq", "msg_idx").drop("seq")


def response_messages(parts: DataFrame) -> DataFrame:
    """One message for each response from its parts: conv_id, response, part, segment, tokens (the provider's input count, of any part)."""
    return parts.groupBy("conv_id", "response").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "segment"))), lambda p: p["segment"]).alias("segments"), F.max("tokens").alias("provider_tokens")
    )


def upsert_system_prompts(messages: DataFrame, prompts: DataFrame) -> DataFrame:
    """Set system prompts (conv_id, seq, text): of several the last holds.

    The first System row is replaced where it stands, pinned, with turn 0; where there is none the
    prompt goes in front, with the turn of the last message, and the others move up by one.
    """
    last = prompts.groupBy("conv_id").agg(F.max_by("text", "seq").alias("prompt"))
    first = messages.filter("role = 'System'").groupBy("conv_id").agg(F.min("msg_idx").alias("slot"))
    turn = messages.groupBy("conv_id").agg(F.max_by("turn", "msg_idx").alias("now"))
    plan = last.join(first, "conv_id", "left").join(turn, "conv_id", "left")
    seen = messages.join(plan, "conv_id", "left")
    hit = F.coalesce(F.col("msg_idx") == F.col("slot"), F.lit(False))
    shifted = F.col("msg_idx") + F.when(F.col("prompt").isNotNull() & F.col("slot").isNull(), 1).otherwise(0)
    out = seen.select(
        "conv_id", shifted.cast("int").alias("msg_idx"), "role", F.when(hit, "Original").otherwise(F.col("state")).alias("state"), (F.col("is_pinned") | hit).alias("is_pinned"), "ts",
        F.when(hit, 0).otherwise(F.col("turn")).alias("turn"), F.when(~hit, F.col("token_count")).alias("token_count"),
        F.when(hit, F.array(text_segment(F.col("prompt")))).otherwise(F.col("segments")).alias("segments"),
    )
    new = plan.filter("slot IS NULL").select(
        "conv_id", F.lit(0).alias("msg_idx"), F.lit("System").alias("role"), F.lit("Original").alias("state"), F.lit(True).alias("is_pinned"),
        F.lit(None).cast("timestamp").alias("ts"), F.coalesce("now", F.lit(0)).alias("turn"), F.lit(None).cast("int").alias("token_count"),
        F.array(text_segment(F.col("prompt"))).alias("segments"),
    )
    return out.unionByName(new.select(*out.columns))
