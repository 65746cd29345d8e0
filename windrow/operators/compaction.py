"""Tool names, the protected tail, masking, turn groups and the emergency drop, on narrow rows.

Contents stay out of the window sorts: all decisions are made on (keys, msg_idx, role, flags, turn,
tokens, masked tokens), and contents are joined back by message at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.text import utf16_length
from windrow.functions.tokens import Counter, count_segments, estimate, message_tokens, segment_chars
from windrow.plans.budget import placeholder

KEYS = ["profile", "conv_id"]


def tool_names(messages: DataFrame) -> DataFrame:
    """conv_id, tool_call_id and the name under which the unpinned messages called it last."""
    calls = messages.filter(~F.col("is_pinned")).select("conv_id", "msg_idx", F.posexplode(F.filter("segments", lambda s: s["kind"] == "tool_use")).alias("seg", "call"))
    return calls.groupBy("conv_id", F.col("call.tool_call_id").alias("tool_call_id")).agg(F.max_by("call.tool_name", F.struct("msg_idx", "seg")).alias("tool_name"))


def resolved_results(messages: DataFrame) -> DataFrame:
    """conv_id, msg_idx, tool_call_id and resolved name of the tool results of unpinned messages; an unknown call's name is its id.

    Calls and results are exploded together, without contents, and meet in one window over the call id:
    one scan and one exchange instead of a join.
    """
    parts = _calls_and_results(messages)
    is_call = F.col("kind") == "tool_use"
    last = F.max_by(F.when(is_call, F.col("name")), F.when(is_call, F.struct("msg_idx", "seg"))).over(Window.partitionBy("conv_id", "tool_call_id"))
    named = parts.withColumn("tool_name", F.coalesce(last, F.col("tool_call_id")))
    return named.filter("kind = 'tool_result'").select("conv_id", "msg_idx", "tool_call_id", "tool_name")


def called_later(messages: DataFrame) -> DataFrame:
    """conv_id of each conversation in which an unpinned call has the id of a result before it."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("msg_idx"))
    spans = _calls_and_results(messages).groupBy("conv_id", "tool_call_id").agg(F.max(at("tool_use")).alias("call"), F.min(at("tool_result")).alias("result"))
    return spans.filter("call > result").select("conv_id").distinct()


def _calls_and_results(messages: DataFrame) -> DataFrame:
    bare = F.transform(F.filter("segments", lambda s: s["kind"] != "text"), lambda s: F.struct(s["kind"].alias("kind"), s["tool_call_id"].alias("id"), s["tool_name"].alias("name")))
    parts = messages.filter(~F.col("is_pinned")).select("conv_id", "msg_idx", F.posexplode(bare).alias("seg", "s"))
    return parts.select("conv_id", "msg_idx", "seg", "s.kind", F.col("s.id").alias("tool_call_id"), "s.name")


def measured(messages: DataFrame, template: str, counter: Counter = count_segments) -> DataFrame:
    """Narrow rows: what each message costs, and what it would cost with its tool results masked (null if it has none).

    names are the tools of its results by call id; nothing reads them unless messages are written out.
    """
    cleared = utf16_length(placeholder(template, F.col("tool_name"), F.col("tool_call_id"))) + utf16_length(F.col("tool_call_id"))
    masks = resolved_results(messages).groupBy("conv_id", "msg_idx").agg(F.sum(cleared).alias("cleared"), F.map_from_entries(F.collect_set(F.when(F.col("tool_call_id").isNotNull(), F.struct("tool_call_id", "tool_name")))).alias("names"))
    rest = F.aggregate(F.filter("segments", lambda s: s["kind"] != "tool_result"), F.lit(0).cast("long"), lambda total, s: total + segment_chars(s))
    rows = messages.select("conv_id", "msg_idx", "role", "state", "is_pinned", "turn", message_tokens(F.col("segments"), F.col("token_count"), counter).alias("tokens"), rest.alias("rest"))
    rows = rows.join(masks, ["conv_id", "msg_idx"], "left")
    return rows.withColumn("masked_tokens", F.when(F.col("cleared").isNotNull(), estimate(F.col("rest") + F.col("cleared")))).drop("rest", "cleared")


def totals(rows: DataFrame, correction: DataFrame | None = None) -> DataFrame:
    """raw, pinned and total tokens of each conversation. correction: conv_id, correction (the anchor's)."""
    whole = Window.partitionBy(*KEYS)
    rows = rows.join(correction, "conv_id", "left") if correction is not None else rows.withColumn("correction", F.lit(0).cast("long"))
    rows = rows.withColumn("correction", F.coalesce("correction", F.lit(0)).cast("long"))
    rows = rows.withColumn("raw", F.sum("tokens").over(whole)).withColumn("pinned", F.coalesce(F.sum(F.when(F.col("is_pinned"), F.col("tokens"))).over(whole), F.lit(0)))
    return rows.withColumn("total", F.col("raw") + F.col("correction"))


def protect(rows: DataFrame) -> DataFrame:
    """is_protected: among the unpinned, the newest window_size, and older ones while all of them fit in the protected share."""
    newest = Window.partitionBy(*KEYS, "is_pinned").orderBy(F.desc("msg_idx"))
    number, tokens = F.row_number().over(newest), F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    share = F.floor((F.col("max_tokens") - F.col("pinned")).cast("double") * F.col("fraction"))
    return rows.withColumn("is_protected", ~F.col("is_pinned") & ((number <= F.col("window_size")) | (tokens <= share)))


def mask(rows: DataFrame) -> DataFrame:
    """is_masked and cost: unprotected tool results are masked, at the masked cost. Masking may raise a short result's cost."""
    rows = rows.withColumn("is_masked", ~F.col("is_pinned") & ~F.col("is_protected") & F.col("masked_tokens").isNotNull())
    return rows.withColumn("cost", F.when(F.col("is_masked"), F.col("masked_tokens")).otherwise(F.col("tokens")))


def preserve(rows: DataFrame, strict: bool = False) -> DataFrame:
    """floor: the index from which nothing is dropped.

    It is the newest unpinned message; if that is a model reply and the unpinned one before it a user
    message, the latter. Without unpinned rows it is the number of rows. strict also preserves the rest
    of the turn that the floor stands in, so that no tool result loses its call.
    """
    whole = Window.partitionBy(*KEYS)
    newest = F.row_number().over(Window.partitionBy(*KEYS, "is_pinned").orderBy(F.desc("msg_idx")))
    rows = rows.withColumn("age", F.when(~F.col("is_pinned"), newest))
    pick = lambda age, column: F.max(F.when(F.col("age") == age, F.col(column))).over(whole)
    floor = F.when((pick(1, "role") == "Model") & (pick(2, "role") == "User"), pick(2, "msg_idx")).otherwise(pick(1, "msg_idx"))
    rows = rows.withColumn("floor", F.coalesce(floor, F.count("*").over(whole)))
    if strict:
        at_floor = F.max(F.when(F.col("msg_idx") == F.col("floor"), F.col("turn"))).over(whole)
        rows = rows.withColumn("floor", F.coalesce(F.min(F.when(~F.col("is_pinned") & (F.col("turn") == at_floor), F.col("msg_idx"))).over(whole), F.col("floor")))
    return rows.drop("age")


def turn_groups(rows: DataFrame) -> DataFrame:
    """turn_group: the number of a run of unpinned messages of one turn before the floor; null elsewhere."""
    order = Window.partitionBy(*KEYS).orderBy("msg_idx")
    droppable = ~F.col("is_pinned") & (F.col("msg_idx") < F.col("floor"))
    starts = droppable & (F.coalesce(F.lag("is_pinned").over(order), F.lit(True)) | (F.col("turn") != F.lag("turn").over(order)))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int") * droppable.cast("int"))
    return rows.withColumn("turn_group", F.when(droppable, F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("starts")


def drop_oldest(rows: DataFrame) -> DataFrame:
    """is_dropped: whole groups from the oldest on, while what is left costs more than the emergency limit."""
    whole = Window.partitionBy(*KEYS)
    before = Window.partitionBy(*KEYS).orderBy("turn_group").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prepared", F.sum("cost").over(whole) + F.col("correction"))
    earlier = F.coalesce(F.sum(F.when(F.col("turn_group").isNotNull(), F.col("cost"))).over(before), F.lit(0))
    return rows.withColumn("is_dropped", F.coalesce(F.col("turn_group").isNotNull() & (F.col("prepared") - earlier > F.col("emergency")), F.lit(False)))


def masked_segments(template: str, segments: Column, names: Column) -> Column:
    """Segments with tool results replaced by the placeholder; ids stay, names become the resolved ones."""

    def clear(s: Column) -> Column:
        name = F.coalesce(F.element_at(names, s["tool_call_id"]), s["tool_call_id"])
        return F.when(s["kind"] == "tool_result", F.struct(s["kind"].alias("kind"), s["tool_call_id"].alias("tool_call_id"), name.alias("tool_name"), placeholder(template, name, s["tool_call_id"]).alias("content"))).otherwise(s)

    return F.transform(segments, clear)
