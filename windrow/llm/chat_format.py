"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns that have `budget_tokens` each, for the system turn, the
repeated history and the new turns together. Running sums of turn tokens place each turn on a token axis
that is divided into blocks of what the budget leaves for new turns: the turns that lie inside a block
form one window, a turn that crosses a block border forms a window of its own. No step looks at a
conversation as a whole. Each window repeats the system turn and as many of the turns before it as fit in
`history_tokens`. Every assistant turn is under the loss mask once, in the window where it is new.

Turns are never cut. A turn that is longer than a block stands in a window of its own, without history;
if it is longer than the budget leaves beside the system turn, that window is the only kind over the
budget. A system turn of more than half the budget is not repeated: it is a window of its own, the first.

Running sums are taken in two levels, within pieces of `piece_turns` turn numbers and over the pieces,
so a long conversation is many small groups.

The template of a turn is `<turn ROLE>`, a line feed, the text, `</turn>` and a line feed. In roles and
texts a backslash becomes `\\b`, `<` becomes `\\l` and `>` becomes `\\g`, so that neither can hold a
control string; replacing back in the reverse order restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _placed(conversations: DataFrame, piece_turns: int) -> DataFrame:
    """Rows with their order (ord), the tokens of the body turns before and up to them (start, end) and those of the conversation's system turn (system)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn") / piece_turns), F.lit(-(2**62))).alias("piece"),
    )
    in_piece = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(in_piece).cast("long"))
    pieces = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.ceil(F.length("text") / 4) + 4
    lead = (F.col("n") == 1) & (F.col("role") == "system")
    sums = rows.groupBy("conv_id", "piece").agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens"), F.max(F.when(lead, tokens)).alias("lead"))
    # only the very first row of a conversation is the system turn, and it stands outside the token axis
    sums = sums.withColumn("first", F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")) == 1)
    sums = sums.select(
        F.col("conv_id").alias("c"), F.col("piece").alias("p"), "first",
        F.coalesce(F.sum("rows").over(pieces), F.lit(0)).alias("rows_before"),
        F.coalesce(F.max(F.when(F.col("first"), F.col("lead"))).over(Window.partitionBy("conv_id")), F.lit(0)).alias("system"),
        F.coalesce(F.sum(F.col("tokens") - F.when(F.col("first"), F.coalesce("lead", F.lit(0))).otherwise(0)).over(pieces), F.lit(0)).alias("tokens_before"),
    )
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    rows = rows.withColumn("is_system", F.col("first") & lead)
    rows = rows.withColumn("size", F.when(F.col("is_system"), 0).otherwise(tokens))
    running = in_piece.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("tokens_before") + F.sum("size").over(running)).withColumn("start", F.col("end") - F.col("size"))
    return rows.select("conv_id", (F.col("rows_before") + F.col("n")).alias("ord"), "role", "text", "is_system", "system", "start", "end")


def format_windows(conversations: DataFrame, budget_tokens: int = 320, history_tokens: int = 64, piece_turns: int = 256) -> DataFrame:
    """conv_id, window, formatted, loss (array of start and len, in code points), n_repeated.

    conversations: conv_id, turn, role, text; other columns are left out. Rows go by turn (nulls
    first), then role and text; a repeated row is a turn of its own. A null text or role is empty, and
    rows with a null conv_id form one conversation. A turn counts ceil(length / 4) + 4 tokens. Of
    system rows only one that opens the conversation is retained in all windows; later ones are
    ordinary turns. The first n_repeated turns of a window stand in earlier windows too. No rows give no
    windows.
    """
    if not 0 <= 2 * history_tokens < budget_tokens:
        raise ValueError("history_tokens must be less than half of budget_tokens")
    rows = _placed(conversations, piece_turns)
    repeats = F.col("system") * 2 <= budget_tokens
    rows = rows.withColumn("span", F.lit(budget_tokens - history_tokens) - F.when(repeats, F.col("system")).otherwise(0))
    system = rows.filter("is_system")
    body = rows.filter(~F.col("is_system"))
    block, last = F.floor(F.col("start") / F.col("span")), F.floor((F.col("end") - 1) / F.col("span"))
    fresh = body.withColumn("window", block * 2 + (block != last).cast("long"))
    windows = fresh.groupBy(F.col("conv_id").alias("c"), "window").agg(F.min("start").alias("at"), F.sum(F.col("end") - F.col("start")).alias("new"), F.first("span").alias("w_span"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))

    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    everywhere = system.filter(repeats).join(windows, same, "left").select("conv_id", F.coalesce("window", F.lit(0)).alias("window"), "ord", "role", "text", (~first).alias("repeated"))
    alone = system.filter(~repeats).select("conv_id", F.lit(-1).cast("long").alias("window"), "ord", "role", "text", F.lit(False).alias("repeated"))
    retained = everywhere.unionByName(alone)
    if history_tokens:
        bins = F.sequence(F.floor(F.col("end") / history_tokens), F.floor(F.col("start") / history_tokens) + 1)
        recent = body.filter(F.col("end") - F.col("start") <= history_tokens).withColumn("bin", F.explode(bins))
        later = windows.filter("at > 0 AND new <= w_span").withColumn("w_bin", F.floor(F.col("at") / history_tokens))
        fits = (F.col("end") <= F.col("at")) & (F.col("start") >= F.col("at") - history_tokens)
        history = recent.join(later, same & (F.col("bin") == F.col("w_bin")) & fits).select("conv_id", "window", "ord", "role", "text", F.lit(True).alias("repeated"))
        retained = retained.unionByName(history)
    new = fresh.select("conv_id", "window", "ord", "role", "text", F.lit(False).alias("repeated"))

    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(AFTER_ROLE))
    parts = retained.unionByName(new).withColumn("head", head).withColumn("body", escape(F.col("text")))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    so_far = Window.partitionBy("conv_id", "window").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("to", F.sum(F.length("piece")).over(so_far))
    trained = ~F.col("repeated") & (F.col("role") == "assistant")
    span = F.struct((F.col("to") - F.length("piece") + F.length("head")).alias("start"), F.length("body").alias("len"))
    turn = F.struct("ord", "piece", F.when(trained, span).alias("span"))
    grouped = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.count_if("repeated").alias("n_repeated"))
    return grouped.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"), "n_repeated",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output of format_windows alone."""
    pieces = F.split("formatted", CLOSE)
    new = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.size(pieces) - 1 - F.col("n_repeated").cast("int"))

    def plain(piece: Column) -> Column:
        head = F.locate(">", piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
        text = F.substring(piece, head + len(AFTER_ROLE), F.length(piece))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["len"].cast("int"))))
    each = windows.select(
        "conv_id", "window", F.size(new).alias("n"), F.array_join(F.transform(new, plain), "").alias("said"),
        F.array_join(learned, "").alias("learned"), F.length("formatted").cast("long").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select(
        "conv_id", "n_turns", "formatted_chars",
        F.array_join(F.transform("all", lambda w: w["said"]), "").alias("said"), F.array_join(F.transform("all", lambda w: w["learned"]), "").alias("learned"),
    )
    return joined.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
