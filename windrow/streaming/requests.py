"""The request loop: lines of JSON in, one response for each, over a registry of open sessions; as a batch and as a stream.

A session is opened by a request, takes submits, and ends by a close, by a submit whose exchange ended for good, or after
a time without requests. Sessions know nothing of each other, so the registry is state by session and not
one table: the batch is a few windows by session, the stream keeps two numbers and the rows that wait
for the watermark. Model calls are not made here; how a submit's exchange ended comes with the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from windrow.functions.text import is_blank
from windrow.sources.automation import parse_requests
from windrow.streaming.sessions import ROCKS, STORE

# Fixed values of the protocol: commands, outcomes that end a session, error codes and messages.
COMMANDS = ("ping", "open_session", "submit", "close_session")
OUTCOMES = {"reply": "reply_received", "degraded": "degraded", "max_turns": "max_turns_reached", "cancelled": "cancelled", "failed": "failed"}
FINAL = ("degraded", "cancelled", "failed")
NEEDS_OBJECT = "Command '{}' requires a JSON object payload."
NO_PATH = "Payload property 'workspacePath' is not supported in automation mode. Provide 'repositoryUrl' only."
NO_URL, NOT_OPEN, NOT_TEXT = "Payload must provide 'repositoryUrl'.", "Session '{}' is not open.", "Payload field '{}' must be a non-empty string."

RESPONSE = "channel string, seq long, ts timestamp, request_id string, command string, session_id string, status string, exchange long, error_code string, error_message string"


def session_name(channel: Column, seq: Column) -> Column:
    """The id that the session opened by a request gets: the same in every run."""
    return F.concat(F.lit("session_"), F.md5(F.concat_ws(":", channel.cast("string"), seq.cast("string"))))


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def route(lines: DataFrame) -> DataFrame:
    """channel, seq, ts, request_id, command, session_id, ending (open, submit, final, close or ping) and the error of each line, as far as they show without state.

    lines: channel, seq and ts (none of them null; channel and seq name a line), line and exchange_kind (how a submit's exchange ended: a key of OUTCOMES; null is a reply). Commands are
    compared without regard to case, payload fields by exact name; those that must be text may not be of another JSON type.
    """
    rows = parse_requests(lines.select("channel", "seq", "ts", "exchange_kind", "line"))
    rows = rows.withColumn("_p", F.try_variant_get(F.try_parse_json("line"), "$.payload", "variant"))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("_p", f"$.{name}", "variant")) == "STRING", F.try_variant_get("_p", f"$.{name}", "string"))
    command = F.lower("command")
    rows = rows.withColumns({"_object": F.coalesce(F.schema_of_variant("_p").startswith("OBJECT"), F.lit(False)), "_session": text("sessionId"), "_message": text("message"), "_path": text("workspacePath"), "_url": text("repositoryUrl")})
    opens, has_session = command == "open_session", command.isin("submit", "close_session")
    message = (
        F.when(F.col("error_code").isNotNull(), F.col("error_message")).when(~command.isin(*COMMANDS), F.concat(F.lit("Command '"), "command", F.lit("' is not supported.")))
        .when((opens | has_session) & ~F.col("_object"), _filled(NEEDS_OBJECT, F.col("command")))
        .when(opens & ~is_blank(F.col("_path")), NO_PATH).when(opens & is_blank(F.col("_url")), NO_URL)
        .when(has_session & is_blank(F.col("_session")), NOT_TEXT.format("sessionId")).when((command == "submit") & is_blank(F.col("_message")), NOT_TEXT.format("message"))
    )
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(~command.isin(*COMMANDS), "unknown_command").when(message.isNotNull(), "invalid_request")
    kind = F.coalesce("exchange_kind", F.lit("reply"))
    ending = F.when(command == "submit", F.when(kind.isin(*FINAL), "final").otherwise("submit")).when(opens, "open").when(command == "close_session", "close").otherwise("ping")
    session = F.when(opens, session_name(F.col("channel"), F.col("seq"))).when(has_session, F.col("_session"))
    outcome = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))[kind]
    status = F.when(command == "submit", F.coalesce(outcome, F.lit("reply_received"))).when(opens, "opened").when(command == "close_session", "closed").otherwise("ok")
    rows = rows.withColumns({"_code": code, "_text": message})
    good = F.col("_code").isNull()
    return rows.select(
        F.col("channel").cast("string").alias("channel"), F.col("seq").cast("long").alias("seq"), "ts", "request_id", "command", F.when(good, session).alias("session_id"),
        F.when(good, ending).alias("ending"), F.when(good, status).alias("status"), F.col("_code").alias("error_code"), F.col("_text").alias("error_message"),
    )


def _respond(rows: DataFrame, is_open: Column, exchange: Column) -> DataFrame:
    lost = F.col("session_id").isNotNull() & (F.col("ending") != "open") & ~is_open
    return rows.select(
        "channel", "seq", "ts", "request_id", "command", "session_id", F.when(~lost, F.col("status")).alias("status"), F.when(~lost & F.col("ending").isin("submit", "final"), exchange).alias("exchange"),
        F.when(lost, "session_not_found").otherwise(F.col("error_code")).alias("error_code"), F.when(lost, _filled(NOT_OPEN, F.col("session_id"))).otherwise(F.col("error_message")).alias("error_message"),
    )


def answer_requests(lines: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """RESPONSE: what each line is answered, over the whole log, in the order of (ts, seq) within a session.

    A submit or close of a session that is not open yet, was ended, or had no request for more than idle_ms is `session_not_found`.
    exchange counts a session's submits. What ends a session ends it for good, so the first such row decides for all after it.
    """
    routed = route(lines)
    stateless, rows = routed.filter("session_id IS NULL"), routed.filter("session_id IS NOT NULL")
    order = Window.partitionBy("session_id").orderBy("ts", "seq", "channel")
    before, to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda condition, span: F.coalesce(F.max(condition).over(span), F.lit(False))
    opened = flag(F.col("ending") == "open", to)
    # what came before the open did not count, so neither does its time
    rows = rows.withColumn("_opened", opened).withColumn("_late", F.when(flag(F.col("ending") == "open", before), (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)) > 1000 * idle_ms))
    ended = flag(F.col("_opened") & F.col("ending").isin("close", "final"), before) | flag(F.coalesce("_late", F.lit(False)), to)
    rows = rows.withColumn("_open", F.col("_opened") & ~ended)
    count = F.sum(F.when(F.col("_open") & F.col("ending").isin("submit", "final"), 1).otherwise(0)).over(to)
    return _respond(rows.withColumn("_n", count), F.col("_open"), F.col("_n")).unionByName(_respond(stateless, F.lit(True), F.lit(None).cast("long")))


WAITING = "ts timestamp, seq long, channel string, request_id string, command string, ending string, status string"
INFO = "last_us long, exchanges long"


class _Registry(StatefulProcessor):
    """One session: rows wait until the watermark has passed them, so that they are taken in the order of the log."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting, self.info = handle, handle.getListState("waiting", WAITING), handle.getValueState("info", INFO)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(r.ts.to_pydatetime(), int(r.seq), r.channel, r.request_id, r.command, r.ending, r.status) for r in part.itertuples()])
            for ms in {_ms(t) for t in part["ts"]}:
                self.handle.registerTimer(ms)
        yield _frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if _ms(r[0]) <= now), key=lambda r: (r[0], r[1], r[2]))
        rest = [r for r in rows if _ms(r[0]) > now]
        if rest:
            self.waiting.put(rest)
        elif rows:
            self.waiting.clear()
        last, exchanges = self.info.get() if self.info.exists() else (None, 0)
        answers, touched = [], bool(due)
        for ts, seq, channel, request_id, command, ending, status in due:
            at = _us(ts)
            if last is not None and at - last > 1000 * self.idle_ms:
                last = None
            head = (channel, seq, ts, request_id, command, key[0])
            if ending == "open":
                last, exchanges = at, exchanges if last is not None else 0
                answers.append((*head, status, None, None, None))
            elif last is None:
                answers.append((*head, None, None, "session_not_found", NOT_OPEN.format(key[0])))
            else:
                exchanges += ending in ("submit", "final")
                answers.append((*head, status, exchanges if ending in ("submit", "final") else None, None, None))
                last = None if ending in ("close", "final") else at
        if last is None or now > last // 1000 + self.idle_ms:
            self.info.clear()  # unknown and closed sessions are answered alike
        elif touched:
            self.info.update((last, exchanges))
            self.handle.registerTimer(last // 1000 + self.idle_ms + 1)
        yield _frame(answers)

    def close(self) -> None:
        pass


def _us(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _ms(ts) -> int:
    return -(-_us(ts) // 1000)


def _frame(answers: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(answers, columns=[c.split()[0] for c in RESPONSE.split(", ")])
    return frame.astype({"exchange": "Int64", "seq": "int64"}).astype({"ts": "datetime64[us]"})


def serve_requests(lines: DataFrame, idle_ms: int = 3_600_000, lateness: str = "10 minutes") -> DataFrame:
    """The same responses for a stream of lines.

    A line whose session matters is answered when the watermark, `lateness` behind the newest line, has passed it; so lines
    that come out of order, and restarts, change no answer. Lines later than that are dropped by the watermark. Sessions
    that ended, and those without requests for idle_ms, leave no state. Needs the RocksDB state store.
    """
    if lines.sparkSession.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"serve_requests needs {STORE} = {ROCKS}")
    routed = route(lines.withWatermark("ts", lateness))
    stateless = _respond(routed.filter("session_id IS NULL"), F.lit(True), F.lit(None).cast("long"))
    rows = routed.filter("session_id IS NOT NULL").select("session_id", "channel", "seq", "ts", "request_id", "command", "ending", "status")
    kept = rows.groupBy("session_id").transformWithStateInPandas(_Registry(idle_ms), RESPONSE, "append", "eventTime")
    return kept.unionByName(stateless)
