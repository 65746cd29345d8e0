"""The request loop: the batch against a plain loop, the stream against the batch."""

import datetime
import json
import os
import random

import pytest

from windrow.streaming import requests, sessions

COLUMNS = "channel string, seq long, ts timestamp, exchange_kind string, line string"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def name(spark, channel, seq):
    from pyspark.sql import functions as F

    return spark.range(1).select(requests.session_name(F.lit(channel), F.lit(seq))).first()[0]


def log(spark, seed, sessions_=12):
    """Lines of several sessions, interleaved, with wrong ones between."""
    r = random.Random(seed)
    rows, seq, clock = [], 0, 0
    open_ = []
    for i in range(sessions_ * 9):
        seq, clock = seq + 1, clock + r.choice([1, 5, 60, 60, 400])
        what = r.choice(["open", "submit", "submit", "submit", "close", "wrong"])
        channel = r.choice("ab")
        put = lambda command, payload, kind=None: rows.append((channel, seq, at(clock), kind, json.dumps({"requestId": f"r{seq}", "command": command, "payload": payload})))  # noqa: B023, E731
        if what == "open" or not open_:
            open_.append((channel, seq))
            put("Open_Session", {"repositoryUrl": "https://github.com/a/b"})
        elif what == "wrong":
            bad = [
                ("open_session", {}), ("open_session", {"workspacePath": "/x", "repositoryUrl": "u"}), ("submit", {"sessionId": " ", "message": "m"}), ("submit", {"sessionId": "s"}), ("submit", {"sessionId": "s", "message": 5}),
                ("close_session", [1]), ("close_session", None), ("stop", {}), ("submit", {"sessionId": "session_none", "message": "m"}), ("ping", None),
            ]
            put(*r.choice(bad))
        else:
            whose = r.choice(open_[-4:])
            session = name(spark, *whose)
            put("submit", {"sessionId": session, "message": "hello"}, r.choice([None, None, "reply", "max_turns", "failed"])) if what == "submit" else put("close_session", {"sessionId": session})
    rows += [("a", seq + 1, at(clock + 1), None, "{oops"), ("a", seq + 2, at(clock + 2), None, "null")]
    return rows


def loop(spark, rows, idle):
    """The registry as a dictionary, line by line."""
    held, out = {}, {}
    for channel, seq, ts, kind, line in sorted(rows, key=lambda r: (r[2], r[1])):
        try:
            request = json.loads(line)
        except ValueError:
            out[seq] = (None, None, "malformed_json")
            continue
        if request is None:
            out[seq] = (None, None, "invalid_request")
            continue
        command, payload = request["command"].lower(), request["payload"]
        if command == "ping":
            out[seq] = ("ok", None, None)
        elif command not in requests.COMMANDS:
            out[seq] = (None, None, "unknown_command")
        elif not isinstance(payload, dict):
            out[seq] = (None, None, "invalid_request")
        elif command == "open_session":
            good = payload.get("repositoryUrl") and not payload.get("workspacePath")
            if good:
                held[name(spark, channel, seq)] = [ts, 0]
            out[seq] = ("opened", None, None) if good else (None, None, "invalid_request")
        elif not all(isinstance(payload.get(k), str) and payload[k].strip() for k in ("sessionId", *(["message"] if command == "submit" else []))):
            out[seq] = (None, None, "invalid_request")
        else:
            mine = held.get(payload["sessionId"])
            if mine is None or (ts - mine[0]).total_seconds() * 1000 > idle:
                held.pop(payload["sessionId"], None)
                out[seq] = (None, None, "session_not_found")
            elif command == "close_session":
                del held[payload["sessionId"]]
                out[seq] = ("closed", None, None)
            else:
                mine[0], mine[1] = ts, mine[1] + 1
                out[seq] = (requests.OUTCOMES[kind or "reply"], mine[1], None)
                if kind in requests.FINAL:
                    del held[payload["sessionId"]]
    return out


IDLE = 900_000


@pytest.fixture(scope="module")
def lines(spark):
    return log(spark, 3)


def test_batch_equals_a_plain_loop(spark, lines):
    got = {r.seq: (r.status, r.exchange, r.error_code) for r in requests.answer_requests(spark.createDataFrame(lines, COLUMNS).repartition(3), IDLE).collect()}
    wanted = loop(spark, lines, IDLE)
    assert got == wanted
    assert {e for _, _, e in wanted.values()} == {None, "malformed_json", "invalid_request", "unknown_command", "session_not_found"}


def test_messages(spark):
    said = lambda command, payload: requests.answer_requests(spark.createDataFrame([("a", 1, at(0), None, json.dumps({"requestId": "r", "command": command, "payload": payload}))], COLUMNS)).first().error_message
    assert said("submit", 3) == "Command 'submit' requires a JSON object payload." and said("Halt", {}) == "Command 'Halt' is not supported."
    assert said("submit", {"sessionId": "x"}) == "Payload field 'message' must be a non-empty string." and said("close_session", {"sessionId": "x"}) == "Session 'x' is not open."
    assert said("open_session", {"repositoryUrl": ""}) == "Payload must provide 'repositoryUrl'."


def test_empty_log(spark):
    assert requests.answer_requests(spark.createDataFrame([], COLUMNS)).count() == 0


def test_stream_equals_the_batch_over_reordered_input_and_a_restart(spark, lines, tmp_path):
    r = random.Random(5)
    ordered = sorted(lines, key=lambda x: x[2])
    shuffled = [x for k in range(0, len(ordered), 6) for x in r.sample(ordered[k : k + 6], len(ordered[k : k + 6]))]  # within the lateness
    batches = [shuffled[k : k + 17] for k in range(0, len(shuffled), 17)]
    end = ordered[-1][2]
    batches += [[("z", 10**6 + k, end + datetime.timedelta(days=k), None, "{oops")] for k in (1, 2)]  # moves the watermark past all others
    source = tmp_path / "in"
    source.mkdir()
    spark.conf.set(sessions.STORE, sessions.ROCKS)

    def run():
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = requests.serve_requests(stream, IDLE, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    try:
        for part in (range(0, 3), range(3, len(batches))):  # the second half after a restart
            for k in part:
                spark.createDataFrame(batches[k], COLUMNS).coalesce(1).write.parquet(str(tmp_path / f"batch{k}"))
                (file,) = (tmp_path / f"batch{k}").glob("*.parquet")
                file.rename(source / f"{k}.parquet")
                os.utime(source / f"{k}.parquet", (1_000_000 + 10 * k,) * 2)
            run()
    finally:
        spark.conf.unset(sessions.STORE)
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).filter("channel <> 'z'").select("seq", "channel", "request_id", "command", "session_id", "status", "exchange", "error_code", "error_message").collect()), key=str)
    batch = requests.answer_requests(spark.createDataFrame(lines, COLUMNS), IDLE).select("seq", "channel", "request_id", "command", "session_id", "status", "exchange", "error_code", "error_message")
    assert got == sorted(map(tuple, batch.collect()), key=str)


def test_state_store_is_checked(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        requests.serve_requests(spark.createDataFrame([], COLUMNS))
