"""Replaying prepare and response logs with the anchor correction."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.plans.budget import Profile
from windrow.plans.points import running, with_masks

STEPS = "conv_id {}, seq long, total long, final long, corr long, ready boolean"


def replay(points: DataFrame, profile: Profile, cumulative: bool = False) -> DataFrame:
    """conv_id, seq, total, final, corr and ready of each prepare, folded in the order of seq.

    points: conv_id, seq, raw (tokens of the log at that prepare), raw_final (tokens after compaction)
    and provider (the input tokens reported for the response that follows, or null). A response sets
    the correction to reported less last estimate; a prepare below the trigger takes raw plus
    correction, which becomes the last estimate; any other compacts, its last estimate is raw_final,
    and the correction returns to 0. Since the last estimate holds the old correction, the new one is
    what is left of the drift only; `cumulative` adds the corrections up instead.

    raw_final must not depend on the correction, so this is for profiles without emergency limit; the
    others go through replay_with_emergency. A null raw or raw_final counts as 0.

    Each step needs the one before it, so a conversation stays in one task, sorted by Spark; the fold reads it
    batch by batch and keeps two numbers, so time and memory do not depend on how long it is.
    """
    trigger = profile.budget.compaction_trigger

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = corr = None
        for batch in batches:
            out = []
            for at, raw, raw_final, provider in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "raw", "raw_final", "provider"))):
                if corr is None or at != conv:
                    conv, corr = at, 0
                total = raw + corr
                ready = total < trigger
                out.append((total, total if ready else raw_final + corr, corr, ready))
                last, kept = (total, corr) if ready else (raw_final, 0)
                corr = kept if provider is None else provider - last + (kept if cumulative else 0)
            columns = zip(*out) if out else ((), (), (), ())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            done = [pa.array(values, of) for values, of in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), *done], ["conv_id", "seq", "total", "final", "corr", "ready"])

    number = lambda name: F.coalesce(F.col(name).cast("bigint"), F.lit(0)).alias(name)
    rows = points.select("conv_id", F.col("seq").cast("bigint").alias("seq"), number("raw"), number("raw_final"), F.col("provider").cast("bigint").alias("provider"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "raw", "raw_final", F.asc_nulls_last("provider"))
    return rows.mapInArrow(fold, STEPS.format(rows.schema["conv_id"].dataType.simpleString()))


class Conversation:
    """One conversation, message by message: the sequential form, for streams and for checks of the set-based one."""

    def __init__(self, profile: Profile):
        self.profile, self.rows, self.turn, self.corr, self.last, self.changed = profile, [], 0, 0, 0, False

    def append(self, role: str, tokens: int, masked_tokens: int | None = None, pinned: bool = False, provider: int | None = None) -> None:
        if provider is not None:
            self.corr = provider - self.last
        self.rows.append({"role": role, "tokens": tokens, "masked_tokens": masked_tokens, "pinned": pinned, "turn": self.turn})
        self.changed = True

    def prepare(self) -> dict:
        budget, window = self.profile.budget, self.profile.window
        if self.changed:
            self.turn, self.changed = self.turn + 1, False
        pinned = sum(r["tokens"] for r in self.rows if r["pinned"])
        total = sum(r["tokens"] for r in self.rows) + self.corr
        out = {"outcome": None, "error": None, "before": total, "after": total, "masked": 0, "dropped": 0, "corr": self.corr, "turn": self.turn, "kept": list(range(len(self.rows)))}
        if pinned > budget.max_tokens:
            return out | {"error": "PinnedTokenBudgetExceeded"}
        if total < budget.compaction_trigger:
            self.last = total
            return out | {"outcome": "Ready"}
        cost = [r["tokens"] for r in self.rows]
        share = int((budget.max_tokens - pinned) * window.fraction // 1)
        count = spent = masked = 0
        open_ = True
        for i in range(len(self.rows) - 1, -1, -1):
            r = self.rows[i]
            if r["pinned"]:
                continue
            open_ = open_ and not (count >= window.size and spent + r["tokens"] > share)
            if open_:
                count, spent = count + 1, spent + r["tokens"]
            elif r["masked_tokens"] is not None:
                cost[i], masked = r["masked_tokens"], masked + 1
        dropped = self._drop(cost, sum(cost) + self.corr)
        kept = [i for i in range(len(self.rows)) if i not in dropped]
        raw = sum(cost[i] for i in kept)
        after, compacted = raw + self.corr, masked + len(dropped)
        self.last, self.corr = raw, 0
        fits = after <= budget.max_tokens + budget.tolerance_tokens
        outcome = ("Compacted" if compacted else "Ready") if fits else ("Degraded" if compacted else "ContextExhausted")
        return out | {"outcome": outcome, "after": after, "masked": masked, "dropped": len(dropped), "kept": kept}

    def _drop(self, cost: list[int], total: int) -> set[int]:
        limit = self.profile.budget.emergency_trigger
        free = [i for i, r in enumerate(self.rows) if not r["pinned"]]
        if limit is None or total <= limit or not free:
            return set()
        floor = free[-1]
        if self.rows[floor]["role"] == "Model" and len(free) > 1 and self.rows[free[-2]]["role"] == "User":
            floor = free[-2]
        dropped: set[int] = set()
        i = 0
        while i < floor and total > limit:
            if self.rows[i]["pinned"]:
                i += 1
                continue
            turn = self.rows[i]["turn"]
            while i < floor and not self.rows[i]["pinned"] and self.rows[i]["turn"] == turn:
                dropped.add(i)
                total -= cost[i]
                i += 1
        return dropped


REPLAY = "conv_id {}, seq long, total long, final long, corr long, masked int, dropped int, outcome string"


class _Sums:
    """Of one conversation so far: running sums of its messages and of its turn groups, some numbers for each."""

    def __init__(self) -> None:
        self.tokens, self.saved = array("q", [0]), array("q", [0])  # by rank
        self.begin, self.plain, self.lower = array("q"), array("q"), array("q")  # of each turn group: its first rank, the sum before it, and that with all masked

    def add(self, tokens_to: int, saved_to: int, start: int, plain: int, lower: int) -> None:
        self.tokens.append(tokens_to)
        self.saved.append(saved_to)
        if not self.begin or self.begin[-1] != start:
            self.begin.append(start)
            self.plain.append(plain)
            self.lower.append(lower)

    def _end(self, groups: int) -> int:
        """The rank of the last message of so many groups."""
        return 0 if not groups else len(self.tokens) - 1 if groups == len(self.begin) else self.begin[groups] - 1

    def dropped(self, excess: int, saving: int, open_: int, droppable: int) -> tuple[int, int]:
        """How many of the oldest messages an excess of tokens drops, whole groups at a time, and their tokens as masked.

        The tokens before a group rise from group to group, so the groups are found by bisection: those up to the
        first message that is not masked by their sums as masked, later ones with the whole saving before them.
        """
        wanted = self._end(bisect_left(self.lower, excess))
        if wanted > open_:
            at, first = max((excess - saving, 0), (self.tokens[open_] if open_ else 0, open_ + 2))
            low, high = bisect_left(self.plain, at), bisect_right(self.plain, at)
            wanted = self._end(bisect_left(self.begin, first, low, high))
        wanted = max(0, min(wanted, droppable))
        return wanted, self.tokens[wanted] + (self.saved[wanted] if wanted < open_ else saving) if wanted else 0


def replay_with_emergency(rows: DataFrame, profile: Profile) -> DataFrame:
    """The same for profiles with an emergency limit, whose compaction depends on the correction: total, final, corr, masked, dropped and outcome of each prepare.

    rows: conv_id, msg_idx, role, is_pinned, tokens, masked_tokens, provider (on model rows, or null);
    the context is prepared before each model row, whose msg_idx is the seq. Of repeated msg_idx the order is not defined.

    What is masked does not depend on the correction and comes from the running sums of `points`. How much is
    dropped is a step function of it, with the sums before turn groups as break points; so the fold that carries the
    correction from prepare to prepare is a bisection at each. It reads a conversation's sorted entries batch by
    batch and holds five numbers for each message at most, so time is n log n and no message is held.
    """
    budget = profile.budget
    limit, most, trigger = budget.emergency_trigger, budget.max_tokens + budget.tolerance_tokens, budget.compaction_trigger
    names = ("conv_id", "is_point", "tokens_to", "saved_to", "start", "at", "lower", "sum", "pinned", "open", "saving", "masked", "droppable", "provider", "point")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums, corr, last = None, None, 0, 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(name).to_pylist() for name in names)):
                at, is_point, tokens_to, saved_to, start, plain, lower, total, pinned, open_, saving, masked, droppable, provider, seq = row
                if sums is None or at != conv:
                    conv, sums, corr, last = at, _Sums(), 0, 0
                if not is_point:
                    sums.add(tokens_to, saved_to, start, plain, lower)
                    continue
                before, used = total + pinned + corr, corr
                if pinned > budget.max_tokens:
                    out.append((at, seq, before, before, used, 0, 0, None))
                elif before < trigger:
                    last = before
                    out.append((at, seq, before, before, used, 0, 0, "Ready"))
                else:
                    prepared = total + pinned + saving
                    dropped, cost = sums.dropped(prepared + corr - limit, saving, open_, droppable) if limit is not None and prepared + corr > limit else (0, 0)
                    last = prepared - cost
                    fits, done = last + corr <= most, masked + dropped > 0
                    out.append((at, seq, before, last + corr, used, masked, dropped, ("Compacted" if done else "Ready") if fits else "Degraded" if done else "ContextExhausted"))
                    corr = 0
                if provider is not None:
                    corr = provider - last
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            columns = zip(*out) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(values, of) for values, of in zip(columns, kinds)], ["conv_id", "seq", "total", "final", "corr", "masked", "dropped", "outcome"])

    # a prepare after which messages came begins a turn: the first one does not, if it had nothing to prepare
    order = Window.partitionBy("conv_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)
    model = (F.col("role") == "Model").cast("int")
    turn = F.sum(model).over(order) - F.when(F.first("role").over(order) == "Model", 1).otherwise(0)
    narrow = rows.select("conv_id", "msg_idx", "role", F.lit("Original").alias("state"), "is_pinned", "tokens", "masked_tokens", F.col("provider").cast("long").alias("provider"), turn.alias("turn"))
    entries = with_masks(running(narrow, first=True, carried=("provider",)), [profile], always=True)
    entries = entries.select(*names).sortWithinPartitions("conv_id", "point", F.desc("is_point"))
    return entries.mapInArrow(fold, REPLAY.format(rows.schema["conv_id"].dataType.simpleString()))


def sequential(rows: Iterator[dict], profile: Profile) -> dict:
    """The final prepare of one conversation, for comparison with the set-based plan."""
    talk = Conversation(profile)
    for r in rows:
        if r["role"] == "Model":
            talk.turn += 1
        talk.append(r["role"], r["tokens"], r["masked_tokens"], r["is_pinned"])
    return talk.prepare()
