"""Conversations and session events as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from windrow.plans.anchor import Conversation
from windrow.plans.budget import Profile
from windrow.sources.transcript import STOPPED, render

OUTPUT = "conv_id long, seq long, outcome string, error string, tokens_before long, tokens_after long, masked long, dropped long"
ROWS = "role string, tokens long, masked_tokens long, pinned boolean, turn int"
MARKS = "last_seq long, closed boolean, turn int, corr long, last long, changed boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(value) -> int | None:
    return None if pd.isna(value) else int(value)


class _Prepares(StatefulProcessor):
    """The counts of a conversation's messages are a list state, which a batch only appends to; all else is one small value."""

    def __init__(self, profile: Profile, idle_ms: int):
        self.profile, self.idle_ms = profile, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows, self.marks = handle, handle.getListState("rows", ROWS), handle.getValueState("marks", MARKS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        talk = Conversation(self.profile)
        last_seq, closed, known = None, False, 0
        if self.marks.exists():
            last_seq, closed, talk.turn, talk.corr, talk.last, talk.changed = self.marks.get()
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        stamps = batch["ts"].dropna()
        if not closed and (batch["kind"] == "prepare").any():
            talk.rows = [{"role": r[0], "tokens": r[1], "masked_tokens": r[2], "pinned": r[3], "turn": r[4]} for r in self.rows.get()]
            known = len(talk.rows)
        out = []
        for r in batch.itertuples():
            if last_seq is not None and r.seq <= last_seq:
                continue
            last_seq = int(r.seq)
            if closed:
                out.append((key[0], last_seq, None, "Closed", None, None, None, None))
            elif r.kind == "close":
                closed = True
            elif r.kind == "append":
                talk.append(r.role, int(r.tokens), _number(r.masked_tokens), bool(r.is_pinned), _number(r.provider))
            else:
                p = talk.prepare()
                out.append((key[0], last_seq, p["outcome"], p["error"], p["before"], p["after"], p["masked"], p["dropped"]))
        if closed:
            self.rows.clear()
        elif len(talk.rows) > known:
            self.rows.appendList([(r["role"], r["tokens"], r["masked_tokens"], r["pinned"], r["turn"]) for r in talk.rows[known:]])
        self.marks.update((last_seq, closed, talk.turn, talk.corr, talk.last, talk.changed))
        if len(stamps):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(stamps.max().value // 1_000_000) + self.idle_ms)
        frame = pd.DataFrame(out, columns=["conv_id", "seq", "outcome", "error", "tokens_before", "tokens_after", "masked", "dropped"])
        yield frame.astype({c: "Int64" for c in ("tokens_before", "tokens_after", "masked", "dropped")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.marks.clear()
        return iter(())

    def close(self) -> None:
        pass


def prepare_stream(log: DataFrame, profile: Profile, idle_ms: int = 3_600_000, lateness: str = "10 minutes") -> DataFrame:
    """The result of each prepare in a stream of log rows, as OUTPUT.

    log: conv_id, seq, ts, kind (`append`, `prepare` or `close`), role, tokens, masked_tokens, is_pinned,
    provider. Rows of one micro-batch are put in the order of seq; a row whose seq is not over the last
    one seen came twice or too late and is left out. A conversation's state is the list of its counts
    (no contents), turn and correction; `close` clears the list, and rows after a close give an error
    row. idle_ms of event time after a conversation's last row its state is cleared as a whole. The time
    is the rows' own (the watermark is `lateness` behind), so an idle stream starts no batches.

    List and value states need the RocksDB state store; the session's setting is checked.
    """
    if log.sparkSession.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"prepare_stream needs {STORE} = {ROCKS}")
    rows = log.select("conv_id", "seq", "ts", "kind", "role", "tokens", "masked_tokens", "is_pinned", "provider").withWatermark("ts", lateness)
    return rows.groupBy("conv_id").transformWithStateInPandas(_Prepares(profile, idle_ms), OUTPUT, "append", "eventTime")


def exchange_counts(events: DataFrame, lateness: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Events and reported tokens by session and window of time; rows later than `lateness` are left out."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", every), "session").agg(F.count("*").alias("events"), F.sum("total_tokens").alias("tokens"))


class _Live(StatefulProcessor):
    """A session's events wait until the watermark has passed them; kept beyond that are the window size and the number of the event that ended it."""

    def __init__(self, schema: StructType, idle_ms: int):
        self.schema, self.idle_ms = schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", self.schema)
        self.marks = handle.getValueState("marks", "window_tokens long, ended long, last_ms long")

    def _row(self, values: tuple) -> tuple:
        """A row of pandas values as plain ones, null for what is missing."""
        plain = {"integer": int, "long": int, "short": int, "byte": int, "double": float, "float": float, "boolean": bool, "string": str}
        out = []
        for value, field in zip(values, self.schema.fields):
            name = field.dataType.typeName()
            out.append(None if value is None or pd.isna(value) else value.to_pydatetime() if name.startswith("timestamp") else plain[name](value))
        return tuple(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([self._row(r) for r in part.itertuples(index=False, name=None)])
            for ms in {_to_ms(t) for t in part["ts"]}:
                self.handle.registerTimer(ms)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, names = timerValues.getCurrentWatermarkInMs(), self.schema.names
        at = {n: names.index(n) for n in ("seq", "ts", "kind", "window_tokens")}
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if _to_ms(r[at["ts"]]) <= now), key=lambda r: r[at["seq"]])
        rest = [r for r in rows if _to_ms(r[at["ts"]]) > now]
        if rest:
            self.waiting.put(rest)
        elif rows:
            self.waiting.clear()
        window, ended, last_ms = self.marks.get() if self.marks.exists() else (None, None, 0)
        out = []
        for r in due:
            if ended is None or r[at["seq"]] <= ended:
                window = window if r[at["window_tokens"]] is None else r[at["window_tokens"]]
                out.append((*r, window))
            if r[at["kind"]] in STOPPED and (ended is None or r[at["seq"]] < ended):
                ended = r[at["seq"]]
        if due:
            last_ms = max(last_ms, *(_to_ms(r[at["ts"]]) for r in due))
            self.marks.update((window, ended, last_ms))
            self.handle.registerTimer(last_ms + self.idle_ms)
        elif not rest and now >= last_ms + self.idle_ms:
            self.marks.clear()
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[*self.schema.names, "session_window"])
        kinds = {"integer": "Int32", "long": "Int64", "boolean": "boolean"}
        frame = frame.astype({f.name: kinds[f.dataType.typeName()] for f in self.schema.fields if f.dataType.typeName() in kinds} | {"session_window": "Int64"})
        return frame.astype({f.name: "datetime64[us]" for f in self.schema.fields if f.dataType.typeName().startswith("timestamp")})

    def close(self) -> None:
        pass


def _to_ms(ts) -> int:
    return -(-pd.Timestamp(ts).value // 1_000_000)


def live_events(events: DataFrame, idle_ms: int = 3_600_000, lateness: str = "10 minutes") -> DataFrame:
    """A stream of events without what follows a session's cancelled or failed event, with session_window, the window size of its start event.

    events: columns of transcript.EVENTS, session, seq, ts, kind and window_tokens among them; seq and ts rise together in a session. An event
    is given out when the watermark, `lateness` behind the newest event, has passed it; so late and reordered events are taken in the
    order of the log, and what comes after an end is left out, as `transcript.transcripts` does for a whole log. A session without
    events for idle_ms leaves no state. Needs the RocksDB state store.
    """
    if events.sparkSession.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"live_events needs {STORE} = {ROCKS}")
    schema = StructType([StructField(f.name, f.dataType) for f in events.schema.fields])
    out = StructType([*schema.fields, StructField("session_window", LongType())])
    return events.withWatermark("ts", lateness).groupBy("session").transformWithStateInPandas(_Live(schema, idle_ms), out, "append", "eventTime")


def live_status(events: DataFrame, idle_ms: int = 3_600_000, lateness: str = "10 minutes") -> DataFrame:
    """session, seq, tokens_after and window_tokens of each prepared event of a stream: transcript.status with state in place of a window."""
    live = live_events(events, idle_ms, lateness)
    return live.filter("kind = 'prepared'").select("session", "seq", "tokens_after", F.col("session_window").alias("window_tokens"))


def write_transcripts(events: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each micro-batch of events to text files by session. A batch that is run again replaces its own folder.

    Pass live_events(events) to leave out what follows a session's end.
    """

    def write(batch: DataFrame, number: int) -> None:
        rendered = render(batch).repartition("session").sortWithinPartitions("session", "seq").select("session", F.col("text").alias("value"))
        rendered.write.mode("overwrite").partitionBy("session").text(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def observe(results: DataFrame, observer: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of results where something was compacted to an observer."""
    changed = results.filter("masked > 0 OR dropped > 0")
    return changed.writeStream.foreachBatch(observer).option("checkpointLocation", checkpoint).start()
