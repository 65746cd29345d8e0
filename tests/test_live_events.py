"""Streams of events that end sessions and carry the window size, against the same operators over the whole log."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from windrow.sources import transcript
from windrow.streaming import sessions

KINDS = ["user_prompt", "prepared", "model_requested", "model_responded", "assistant_reply"]


def log(seed):
    r = random.Random(seed)
    rows = []
    for s in range(6):
        end = r.choice([None, 5, 9])
        for seq in range(14):
            kind = "session_started" if seq == 0 else "session_cancelled" if seq == end else "session_ended" if seq == 13 and end is None else r.choice(KINDS)
            rows.append({"session": f"s{s}", "seq": seq, "ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=30 * seq + s), "kind": kind, "content": f"c{s}-{seq}" if seq % 3 else None,
                         "turn": seq, "exchange": seq, "window_tokens": 1000 + s if seq == 0 else None, "soft_ratio": 0.8, "hard_ratio": 1.0, "window_size": 3, "workspace": "w", "workspace_path": "p", "model": "m", "label": "l",
                         "tokens_after": 10 * seq if kind == "prepared" else None})
    return rows


def test_stream_equals_the_batch(spark, tmp_path):
    schema = spark.createDataFrame([], transcript.EVENTS).schema
    rows = sorted(log(1), key=lambda r: r["ts"])
    frame = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    r = random.Random(2)
    shuffled = [x for k in range(0, len(rows), 8) for x in r.sample(rows[k : k + 8], len(rows[k : k + 8]))]
    batches = [shuffled[k : k + 15] for k in range(0, len(shuffled), 15)]
    last = rows[-1]["ts"]
    batches += [[{"session": "z", "seq": k, "ts": last + datetime.timedelta(days=k), "kind": "user_prompt"}] for k in (1, 2)]
    source = tmp_path / "in"
    source.mkdir()
    for k, batch in enumerate(batches):
        spark.createDataFrame([tuple(x.get(f.name) for f in schema.fields) for x in batch], schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        (file,) = (tmp_path / f"b{k}").glob("*.parquet")
        file.rename(source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_000_000 + 10 * k,) * 2)
    spark.conf.set(sessions.STORE, sessions.ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        for name, made in (("live", sessions.live_events(stream, lateness="10 minutes")), ("status", sessions.live_status(stream, lateness="10 minutes"))):
            query = made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.unset(sessions.STORE)
    live = spark.read.parquet(str(tmp_path / "live")).filter("session <> 'z'")
    whole = lambda df: {r["session"]: r["text"] for r in transcript.transcripts(df).collect()}
    # nothing that the batch leaves out is in the stream, and all else is
    assert live.filter("kind IN ('session_cancelled')").count() > 0
    end = {r["session"]: r["seq"] for r in rows if r["kind"] == "session_cancelled"}
    assert sorted((x.session, x.seq) for x in live.collect()) == sorted((x["session"], x["seq"]) for x in rows if x["seq"] <= end.get(x["session"], 99))
    assert whole(live.drop("session_window")) == whole(frame)
    batch = transcript.status(frame).collect()
    wanted = sorted((x.session, x.seq, x.tokens_after, x.window_tokens) for x in batch if x.seq <= end.get(x.session, 99))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "status")).filter("session <> 'z'").collect())) == wanted and len(wanted) > 5


def test_state_store_is_checked(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        sessions.live_events(spark.createDataFrame([], transcript.EVENTS))
