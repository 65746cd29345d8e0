"""The outcome of every prepare point of a log, from running sums instead of a copy of each prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.tokens import Counter, count_segments
from windrow.operators.compaction import KEYS, called_later, measured
from windrow.plans.budget import BudgetError, Profile
from windrow.plans.prepare import labelled, prefixes, prepare


def _zero() -> Column:
    return F.lit(0).cast("long")


def prepare_points(messages: DataFrame, profiles: Sequence[Profile], counter: Counter = count_segments) -> DataFrame:
    """The results of `prepare` for each model row's prefix (the messages before it): conv_id, point, profile and results.

    The same as prepare(prefixes(messages), profiles).results, with rows in proportion to the log. Among the
    unpinned messages of a prefix those masked, and those dropped, are always the oldest ones, so each prefix
    needs a few places in running sums only. They are found by sorting points in between the messages; all
    sorts share their keys. A model row without messages before it has no row, nor has one without conv_id; token counts are not negative.

    A conversation in which a call takes the id of an earlier result anew has other placeholders in
    later prefixes; it goes by `prefixes`. One job looks for such conversations.
    """
    templates = {p.window.placeholder for p in profiles}
    if len(templates) != 1:
        raise BudgetError("the profiles of one run share one placeholder")
    renamed, steady = called_later(messages), measured(messages, templates.pop(), counter)
    if renamed.isEmpty():
        return _from_sums(running(steady), profiles)
    steady = _from_sums(running(steady.join(renamed, "conv_id", "left_anti")), profiles)
    copies = prepare(prefixes(messages.join(renamed, "conv_id", "left_semi"), counter), profiles, counter=counter).results
    copies = copies.withColumn("point", F.col("conv_id.point")).withColumn("conv_id", F.col("conv_id.conv_id"))
    return steady.unionByName(copies.select(*steady.columns))


def running(narrow: DataFrame, first: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """entry rows of each conversation (with `first` also points without messages before them; with the columns `carried`): its unpinned messages (is_point false) and its model rows as points.

    rank counts the unpinned messages up to this one; tokens_to, saved_to and masks_to are sums up to and with
    it; start, at and lower are the rank of its turn group's first message and the sums before that, as they are and
    masked. A point has the sums of what comes before it.
    """
    order = Window.partitionBy("conv_id").orderBy("msg_idx")
    to, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    free = ~F.col("is_pinned")
    total = lambda condition, value, span: F.coalesce(F.sum(F.when(condition, value)).over(span), _zero())
    saving = F.coalesce(F.col("masked_tokens") - F.col("tokens"), _zero())
    masks = (F.col("masked_tokens").isNotNull() & (F.col("state") == "Original")).cast("long")
    begins = free & F.coalesce(F.coalesce(F.lag("is_pinned").over(order), F.lit(True)) | (F.col("turn") != F.lag("turn").over(order)), F.lit(True))
    rows = narrow.select(
        "conv_id", "msg_idx", "role", "is_pinned", *carried, begins.alias("begins"),
        total(free, F.lit(1), to).alias("rank"), total(free, F.col("tokens"), to).alias("tokens_to"), total(free, saving, to).alias("saved_to"), total(free, masks, to).alias("masks_to"),
        total(free, F.lit(1), before).alias("n"), total(free, F.col("tokens"), before).alias("sum"), total(free, saving, before).alias("saved"), total(~free, F.col("tokens"), before).alias("pinned"),
        F.count("*").over(before).alias("earlier"), F.last(F.when(free, F.col("role")), True).over(before).alias("last_role"),
    )
    group = F.last(F.when(F.col("begins"), F.struct(F.col("rank").alias("start"), F.col("sum").alias("at"), (F.col("sum") + F.col("saved")).alias("lower"))), True).over(to)
    # the roles of the last two unpinned messages
    last_two = F.last(F.when(free, F.struct(F.col("role").alias("one"), F.col("last_role").alias("two"))), True).over(before)
    rows = rows.withColumn("group", group).withColumn("last_two", last_two)
    kinds = F.filter(F.array(F.when(free, F.lit(False)), F.when((F.col("role") == "Model") & (F.lit(first) | (F.col("earlier") > 0)), F.lit(True))), lambda k: k.isNotNull())
    kept = (F.col("last_two.one") == "Model") & (F.col("last_two.two") == "User")
    droppable = F.greatest(F.col("n") - F.when(kept, 2).otherwise(1), _zero())
    return rows.filter("conv_id IS NOT NULL").select(
        "conv_id", F.explode(kinds).alias("is_point"), F.col("msg_idx").alias("point"), "rank", "tokens_to", "saved_to", "masks_to", "group.start", "group.at", "group.lower",
        "n", "sum", "pinned", droppable.alias("droppable"), *carried,
    )


def _reached(entries: DataFrame, name: str, row: Sequence[Column], point: Sequence[Column], found: Column) -> DataFrame:
    """Entries with, at each point, what the last message has whose `row` key sorts before the `point` key; null if none has."""
    keys = [F.when(F.col("is_point"), p).otherwise(r) for r, p in zip(row, point)]
    span = Window.partitionBy(*KEYS).orderBy(*keys, F.desc("is_point"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn(name, F.last(F.when(~F.col("is_point"), found), True).over(span))


def with_masks(entries: DataFrame, profiles: Sequence[Profile], always: bool = False) -> DataFrame:
    """Entries for each profile, at each point with total, error and, as far as it is neither ready nor in error (or `always`), the messages outside the window (open) and what masking them changes.

    masking: the sums up to the last message outside; saving: the tokens it adds (under 0: saves); masked: how many are masked.
    """
    sums = F.struct("tokens_to", "saved_to", "masks_to")
    number = lambda name: F.coalesce(F.col(name), _zero())
    e = entries.select("*", F.inline(F.array(*(p.column() for p in profiles)))).withColumn("total", F.col("sum") + F.col("pinned"))
    e = e.withColumn("error", F.when(F.col("pinned") > F.col("max_tokens"), "PinnedTokenBudgetExceeded")).withColumn("is_ready", F.col("total") < F.col("trigger"))
    idle = _idle() if not always else F.lit(False)

    # masked: outside the newest window_size, and where what follows exceeds the protected share
    share = F.floor((F.col("max_tokens") - F.col("pinned")).cast("double") * F.col("fraction"))
    e = _reached(e, "outside", [F.col("tokens_to")], [F.col("sum") - share], F.col("rank"))
    # a message is outside if the sum before it is under the limit: one more than those whose own sum is
    over = F.when(F.col("sum") - share > 0, number("outside") + 1).otherwise(_zero())
    e = e.withColumn("open", F.when(idle, _zero()).otherwise(F.greatest(F.least(over, F.col("n") - F.col("window_size")), _zero())))
    e = _reached(e, "masking", [F.col("rank")], [F.col("open") + 1], sums)
    return e.withColumn("saving", F.when(F.col("open") > 0, F.col("masking.saved_to")).otherwise(_zero())).withColumn("masked", F.when(F.col("open") > 0, F.col("masking.masks_to")).otherwise(_zero()))


def _idle() -> Column:
    return F.col("is_ready") | F.col("error").isNotNull()


def _from_sums(entries: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    sums = F.struct("tokens_to", "saved_to", "masks_to")
    number = lambda name: F.coalesce(F.col(name), _zero())
    e, idle = with_masks(entries, profiles), _idle()

    # dropped: groups while the sum before them leaves more than the emergency limit; those that begin up to
    # the first unmasked message count as masked before it, later ones have the whole saving before them
    e = e.withColumn("prepared", F.col("total") + F.col("saving")).withColumn("excess", F.col("prepared") - F.col("emergency"))
    e = _reached(e, "inside", [F.col("lower")], [F.col("excess")], F.col("rank"))
    to_open = F.when(F.col("open") > 0, F.col("masking.tokens_to")).otherwise(_zero())
    later = F.greatest(F.struct((F.col("excess") - F.col("saving")).alias("at"), _zero().alias("start")), F.struct(to_open.alias("at"), (F.col("open") + 2).alias("start")))
    e = _reached(e.withColumn("later", later), "beyond", [F.col("at"), F.col("start")], [F.col("later.at"), F.col("later.start")], F.col("rank"))
    wanted = F.when(number("inside") <= F.col("open"), number("inside")).otherwise(number("beyond"))
    wanted = F.when(idle | F.col("emergency").isNull(), _zero()).otherwise(F.least(wanted, F.col("droppable")))
    e = _reached(e.withColumn("dropped", wanted), "dropping", [F.col("rank")], [F.col("dropped") + 1], sums)
    cost = F.col("dropping.tokens_to") + F.when(F.col("dropped") < F.col("open"), F.col("dropping.saved_to")).otherwise(F.col("saving"))
    results = e.filter("is_point").select(
        *KEYS, "point", "max_tokens", "tolerance", "error", "is_ready", F.col("total").alias("tokens_before"), _zero().alias("correction"), "masked", "dropped",
        (F.col("prepared") - F.when(F.col("dropped") > 0, cost).otherwise(_zero())).alias("raw_final"), F.col("sum").alias("strategy_before"), (F.col("sum") + F.col("saving")).alias("strategy_after"),
    )
    return labelled(results)
