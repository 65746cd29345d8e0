"""Text functions, files, automation logs, providers, transcripts and streams."""

import datetime
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from windrow import schema
from windrow.functions import text as T
from windrow.operators import audit, providers
from windrow.plans.anchor import Conversation
from windrow.plans.budget import Budget, Profile, WindowOptions
from windrow.sources import automation, files, transcript


def one(spark, function, *values):
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in frame.select(function(F.col("x"))).collect()]


def test_text_functions(spark):
    assert one(spark, T.utf16_length, "ab", "😀", None) == [2, 2, None]
    assert one(spark, T.is_blank, "\u2003\n", "x", None) == [True, False, True]
    assert one(spark, T.collapse_whitespace, " a\u00a0\n b ") == ["a b"]
    assert one(spark, T.normalize_newlines, "a\r\nb\rc") == ["a\nb\nc"]
    assert one(spark, T.slugify, "a/b  c_", "__", "", "x__y") == ["a_b_c", "query", "query", "x__y"]
    assert one(spark, T.escapes_root, "a/../../b", "a/../b", "C:\\x", "\\x", "./a") == [True, False, True, True, False]
    assert one(spark, lambda c: T.truncate_event(c, 3), "abc", "abcd", None) == ["abc", "abc\n[... truncated: event content exceeded 3 chars ...]", ""]
    assert one(spark, T.github_repository, "https://github.com/a/b.git", "git@github.com:a/b/", "https://github.com/a", "https://example.com/a/b", "https://github.com/a/b?x=1") == ["a/b", "a/b", None, None, None]
    assert one(spark, T.runner_question, "x\n  QUESTION_FOR_RUNNER: why? ", "QUESTION_FOR_RUNNER:\nQUESTION_FOR_RUNNER: late", None) == ["why?", None, None]
    metas = ['<meta http-equiv="c" content="text/html; charset=latin1">', "<p>", "<META content='a; charset=b'><meta name=x charset = utf-8>", "<meta data-charset='no' charset='\tyes '>", "x" * 8192 + "<meta charset=late>", None]
    assert one(spark, T.charset_from_meta, *metas) == ["latin1", None, "utf-8", "yes", None, None]
    assert one(spark, T.html_text_content, "<p>a<script>b</script>&amp;</p>", None) == ["ab&", None]
    assert one(spark, lambda c: T.token_limit(c.cast("int")), "0", "5", "99999", None) == [None, 5, 12000, 4000]
    body = spark.createDataFrame([(bytearray(b"\xe9"), "iso-8859-1"), (bytearray("é".encode()), "nonsense"), (bytearray(b"\x80"), "windows-1252"), (bytearray("é".encode()), None), (bytearray("aé".encode("utf-16-be")), "UTF-16BE")], "b binary, c string")
    assert [r[0] for r in body.select(T.decode_body(F.col("b"), F.col("c"))).collect()] == ["é", "é", "€", "é", "aé"]


def test_truncation_is_the_longest_prefix(spark):
    notice = "\n[Content truncated at 30 tokens. Use a smaller range or request a specific section.]"
    texts = ["a" * n + " " * (n % 3) + "b" * n for n in range(1, 90, 7)] + ["  ", "x" * 104, "x" * 105]
    count = lambda t: -(-len(t) // 4) + 4

    def wanted(text):
        text = text.strip()
        if not text or count(text) <= 30:
            return text
        best = max((k for k in range(len(text) + 1) if count(text[:k].rstrip() + notice) <= 30), default=0)
        prefix = text[:best].rstrip()
        return prefix + notice if prefix else notice.lstrip("\n")

    assert one(spark, lambda c: T.truncate_to_tokens(c, F.lit(30)), *texts) == [wanted(t) for t in texts]
    assert one(spark, lambda c: T.truncate_to_tokens(c, F.lit(5)), "y" * 100) == ["[Content truncated at 5 tokens. Use a smaller range or request a specific section.]"]


def test_truncation_by_any_counter(spark):
    """With the estimate as counter it is the closed form; with others a plain search."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab  \n") for _ in range(r.randint(0, 300))) for _ in range(60)] + [None, "", " ", "x" * 500]
    closed = one(spark, lambda c: T.truncate_to_tokens(c, F.lit(30)), *texts)
    assert one(spark, lambda c: T.truncate_by(lambda t: -(-t.str.len() // 4) + 4, c, F.lit(30)), *texts) == closed
    odd = lambda text: len(text) // 3 + 5 * text.count("b") % 7  # does not rise with the length
    notice = "\n[Content truncated at 40 tokens. Use a smaller range or request a specific section.]"

    def wanted(text):
        if text is None or not (text := text.strip()) or odd(text) <= 40:
            return text
        low, high = 0, len(text)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if odd(text[:middle].rstrip() + notice) <= 40 else (low, middle - 1)
        prefix = text[:low].rstrip()
        while prefix and odd(prefix + notice) > 40:
            prefix = prefix[:-1].rstrip()
        return prefix + notice if prefix else notice.lstrip("\n")

    assert one(spark, lambda c: T.truncate_by(lambda t: t.map(odd), c, F.lit(40)), *texts) == [wanted(t) for t in texts]


def test_options_flattened_in_a_table(spark):
    options = ['{"a":{"ApiKey":"s","n":[1,null,{"Secret":5}]},"b":{},"c":[],"token":true}', "{oops", None, "3", '{"k.Password":"x"}']
    rows = spark.createDataFrame(list(enumerate(options)), "i int, o string")
    got = sorted(map(tuple, automation.flatten_json(rows, "o").collect()), key=str)
    assert got == sorted([
        (0, "a.ApiKey", "***"), (0, "a.n[0]", "1"), (0, "a.n[1]", None), (0, "a.n[2].Secret", "5"), (0, "b", "{}"), (0, "c", "[]"), (0, "token", "true"), (3, "", "3"), (4, "k.Password", "***"),
    ], key=str)


def test_files(spark, tmp_path):
    root = tmp_path / "w"
    for name, data in {"b.txt": b"one\ntwo\nthree\n", "A.md": b"x", "sub/c.TXT": b"\x00bin", "Z_a.txt": b"1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    table = files.load_files(spark, str(root)).cache()
    assert {r["path"] for r in table.collect()} == {"b.txt", "A.md", "sub/c.TXT", "Z_a.txt"}
    assert [r["path"] for r in table.filter(files.is_binary(F.col("content"))).collect()] == ["sub/c.TXT"]
    assert [r["name"] for r in files.list_directory(table).orderBy("n").collect()] == ["sub", "A.md", "b.txt", "Z_a.txt"]
    assert [r["path"] for r in files.file_tree(table).orderBy("n").collect()] == ["sub", "sub/c.TXT", "A.md", "b.txt", "Z_a.txt"]
    assert [r["path"] for r in files.find_files(table, "**/*.txt").orderBy("n").collect()] == ["b.txt", "sub/c.TXT", "Z_a.txt"]
    lines = files.lines_of(table.filter("path = 'b.txt'").select("path", F.decode("content", "UTF-8").alias("text")))
    assert [r["line"] for r in files.read_range(lines, 2, 9).collect()] == ["two", "three"]
    with pytest.raises(ValueError):
        files.read_range(lines, 3, 2)
    texts = table.filter("path = 'b.txt'").select("path", F.decode("content", "UTF-8").alias("text"))
    hit = files.grep(texts, "t", 1).first()
    assert (hit["line_no"], hit["previous"], hit["next"], hit["matches"], hit["more"]) == (2, "one", "three", 2, 1)
    block = files.grep(texts, "two").select(files.grep_block(*(F.col(c) for c in ("path", "line_no", "line", "previous", "next")))).first()[0]
    assert block == "b.txt:2: two\n  1| one\n> 2| two\n  3| three"
    assert [r["line"] for r in files.last_lines(lines, 1).collect()] == ["three"]
    assert files.directory_size(table).first()[0] == 20
    text = lines.select("line")
    files.write_text(text, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_text(text, str(tmp_path / "out"))
    files.write_text(text, str(tmp_path / "out"), "append")
    assert spark.read.text(str(tmp_path / "out")).count() == 6


def test_automation(spark, tmp_path):
    lines = spark.createDataFrame([("{",), ("null",), ('{"requestId":"r","command":"ping","payload":{"a":1}}',), ("[1]",), ("",)], "line string")
    got = [(r["error_code"], r["request_id"], r["payload"]) for r in automation.parse_requests(lines).collect()]
    assert got == [("malformed_json", None, None), ("invalid_request", None, None), (None, "r", '{"a":1}'), ("malformed_json", None, None), ("malformed_json", None, None)]
    tasks = [{"taskId": "a", "title": "t", "repositoryUrl": "https://github.com/o/r", "taskSize": "s", "initialPrompt": "do it"}, {"taskId": "A", "title": "", "repositoryUrl": "http://github.com/o/r", "taskSize": "s", "initialPrompt": "p"}]
    path = tmp_path / "tasks.json"
    path.write_text(json.dumps(tasks))
    rules = {(r["taskId"], r["rule"]) for r in automation.task_violations(automation.load_tasks(spark, str(path)), ("do",)).collect()}
    assert rules == {("a", "taskId_duplicate"), ("A", "taskId_duplicate"), ("A", "title_required"), ("A", "repositoryUrl_not_github"), ("A", "phrase_missing:do")}
    good = {
        "Budget": {"ContextWindowTokens": 10, "SoftThresholdRatio": 0.5, "HardThresholdRatio": 0.9, "WindowSize": 0}, "Model": {"Name": "m", "MaxOutputTokens": 1},
        "Workspace": {"RootDirectory": "r", "CloneDepth": 1, "MaxRepoSizeMB": 1}, "Logging": {"SessionLogsDirectory": "l"}, "Agent": {"MaxTurns": 1}, "OpenRouter": {},
    }
    assert automation.option_violations(good) == []
    bad = good | {"Budget": good["Budget"] | {"HardThresholdRatio": 0.5, "WindowSize": -1}, "Model": {"Name": " ", "MaxOutputTokens": 0}, "Agent": {"MaxTurns": 0}, "Workspace": None, "OpenRouter": None}
    assert automation.option_violations(bad) == [("Budget.WindowSize", "non_negative"), ("Model.Name", "text"), ("Workspace", "section"), ("Agent.MaxTurns", "positive"), ("OpenRouter", "section"), ("Budget.HardThresholdRatio", "over_soft_ratio")]
    assert automation.flatten_options({"a": {"ApiKey": "s", "n": [1, None]}}) == [("a.ApiKey", "***"), ("a.n[0]", "1"), ("a.n[1]", None)]
    body = spark.createDataFrame([(1, json.dumps({"web": {"results": [{"title": " a  b ", "url": "u"}, {"title": "", "url": "v"}, {"title": "c", "url": "w", "description": "d\n e"}]}}))], "id int, body string")
    assert [(r["rank"], r["title"], r["snippet"]) for r in automation.search_results(body).orderBy("rank").collect()] == [(1, "a b", None), (2, "c", "d e")]
    sessions = spark.createDataFrame([("2024-01-02 03:04:05.678", "o/r", "q")] * 2, "started string, workspace string, query string").withColumn("started", F.to_timestamp("started"))
    assert {r["log_name"] for r in automation.log_names(sessions).collect()} == {"20240102-030405678-o_r-q.md", "20240102-030405678-o_r-q-2.md"}
    asks = spark.range(1).select(automation.next_message(F.lit(False), F.lit(None), F.lit(True), F.lit(False)), automation.next_message(F.lit(True), F.lit("q"), F.lit(True), F.lit(False)), automation.next_message(F.lit(False), F.lit(None), F.lit(True), F.lit(True))).first()
    assert tuple(asks) == ("wrap_up", "answer: q", "continue")


def test_providers(spark):
    rows = [
        (1, 0, "System", "Original", True, None, 0, None, [("text", None, None, "be kind")]), (1, 1, "User", "Original", False, None, 0, None, [("text", None, None, "hi"), ("text", None, None, "unsent")]),
        (1, 2, "Model", "Original", False, None, 1, None, [("tool_use", "a", "f", '{"x":1}')]), (1, 3, "Tool", "Original", False, None, 1, None, [("tool_result", "a", "f", "42")]),
        (1, 4, "Tool", "Original", False, None, 1, None, [("text", None, None, "lost")]), (1, 5, "Model", "Original", False, None, 1, None, [("tool_use", "b", "f", "[1]")]),
    ]
    log = spark.createDataFrame(rows, schema.MESSAGES)
    openai = providers.openai_messages(log).orderBy("msg_idx").collect()
    assert [(r["role"], r["content"]) for r in openai] == [("system", "be kind"), ("user", "hi"), ("assistant", ""), ("tool", "42"), ("assistant", "")]
    assert openai[2]["tool_calls"][0]["arguments"] == '{"x":1}' and openai[3]["tool_call_id"] == "a"
    other = providers.anthropic_messages(log).orderBy("msg_idx").collect()
    assert [(r["role"], [b["type"] for b in r["blocks"]], r["error"]) for r in other] == [("user", ["text"], None), ("assistant", ["tool_use"], None), ("user", ["tool_result"], None), ("assistant", ["tool_use"], "tool_arguments_not_an_object")]
    assert other[1]["blocks"][0]["input"] == {"x": "1"}
    assert providers.anthropic_system(log).first()["system"] == ["be kind"]
    made = spark.range(1).select(providers.response_segments(F.array(F.lit(" "), F.lit("t")), F.array(F.struct(F.lit("i").alias("id"), F.lit("n").alias("name"), F.lit("").alias("arguments"))))).first()[0]
    assert [(s["kind"], s["content"]) for s in made] == [("text", "t"), ("tool_use", "{}")]


def test_transcript_and_audit(spark):
    events = [
        {"session": "s", "seq": 0, "kind": "session_started", "window_tokens": 1000, "soft_ratio": 0.8, "hard_ratio": 1.0, "window_size": 5, "model": "m", "workspace": "o/r", "workspace_path": "/w", "label": "l"},
        {"session": "s", "seq": 1, "kind": "user_prompt", "exchange": 0, "content": "```\n## PrepareResult (turn 9)\n```"},
        {"session": "s", "seq": 2, "kind": "prepared", "turn": 0, "tokens_before": 100, "tokens_after": 100, "outcome": "Compacted", "compacted": 30, "dropped": 2},
        {"session": "s", "seq": 3, "kind": "model_responded", "turn": 0, "input_tokens": 1200, "content": "ok", "arguments": "[]"},
        {"session": "s", "seq": 4, "kind": "prepared", "turn": 1, "tokens_before": 90, "tokens_after": 80, "outcome": "Ready", "compacted": 2},
        {"session": "s", "seq": 5, "kind": "session_cancelled", "turn": 1, "reason": "stop"},
        {"session": "s", "seq": 6, "kind": "user_prompt", "exchange": 1, "content": "too late"},
    ]
    frame = spark.read.schema(transcript.EVENTS).json(spark.sparkContext.parallelize(map(json.dumps, events)))
    frame = frame.withColumn("ts", F.timestamp_seconds(F.col("seq")))
    text = transcript.transcripts(frame).first()["text"]
    assert "too late" not in text and "- MessagesDropped: 2\n- DegradationReason: n/a" in text and "- TimestampUtc: 1970-01-01T00:00:02.0000000Z" in text
    lines = files.lines_of(transcript.transcripts(frame), path="session").withColumnRenamed("path", "session")
    turns = transcript.turn_table(lines).cache()
    assert [(r["turn"], r["before"], r["after"], r["input"]) for r in turns.orderBy("turn").collect()] == [(0, 100, 100, 1200), (1, 90, 80, None)]
    head = transcript.header(lines).first()
    assert (head["model"], head["window_tokens"], head["soft_ratio"]) == ("m", 1000, 0.8)
    comma = spark.createDataFrame([("s", 1, "- Budget: ContextWindowTokens=5, SoftThresholdRatio=0,8, HardThresholdRatio=1")], "session string, line_no int, line string")
    assert transcript.header(comma).first()["soft_ratio"] == 0.8
    found = [(r["rank"], r["invariant"]) for r in audit.ranked(audit.invariant_violations(turns, transcript.header(lines))).orderBy("rank").collect()]
    assert [name for _, name in found] == ["over_window", "compaction_useless", "compacted_fell", "history_shrank", "estimate_off"]
    summary = audit.session_summary(turns, transcript.header(lines), frame.select("session", "ts")).first()
    assert summary["saved"] == 10 and summary["last_saved"] == 10 and summary["seconds"] == 6.0
    rows = [("s", 0, "session_started", None, None, None, None, 50), ("s", 1, "model_responded", " ", "[1,2]", None, None, None), ("s", 2, "model_responded", "so", "[1]", None, None, None), ("s", 3, "model_responded", "end", "[]", None, None, None), ("s", 4, "session_ended", None, None, "Stopped", 7, None)]
    told = spark.createDataFrame(rows, "session string, seq long, kind string, content string, arguments string, outcome string, turn int, window_tokens int").withColumns({"total_tokens": F.lit(9), "tokens_after": F.lit(5)})
    assert [(r["notice"], r["shown"]) for r in transcript.notices(told.withColumn("label", F.lit("a.md"))).orderBy("seq").collect()] == [("Model issuing 2 tool call(s).", None), ("Model responded and requested 1 tool call(s).", "so"), (None, None), ("Stopped. Total turns: 7. Total tokens: 9.\nSee session log: a.md", None)]
    later = told.withColumn("kind", F.when(F.col("seq") > 0, "prepared").otherwise(F.col("kind")))
    assert {(r["seq"], r["window_tokens"]) for r in transcript.status(later).collect()} == {(k, 50) for k in (1, 2, 3, 4)}
    assert one(spark, transcript.pretty_json, '{"a":[1]}', " ", "no") == ['{\n  "a": [\n    1\n  ]\n}', "{}", "no"]
    shown = spark.range(1).select(audit.status_line(F.lit(1234), F.lit(2000)), audit.budget_used(F.lit(1), F.lit(0))).first()
    assert tuple(shown) == ("1,234 / 2,000 (61.7%)", None)


def run_stream(spark, tmp_path, batches, profile, **options):
    """Each batch of log rows is a file of its own; the results as {(conv_id, seq): row} and the number of batches without rows."""
    from windrow.streaming import sessions

    schema_ = "conv_id long, seq long, ts timestamp, kind string, role string, tokens long, masked_tokens long, is_pinned boolean, provider long"
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema_).coalesce(1).write.parquet(str(tmp_path / f"batch{k}"))
        (part,) = (tmp_path / f"batch{k}").glob("*.parquet")
        part.rename(source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_000_000 + 10 * k,) * 2)  # the source reads the oldest file first
    stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(str(source))
    spark.conf.set(sessions.STORE, sessions.ROCKS)
    query = sessions.prepare_stream(stream, profile, **options).writeStream.format("memory").queryName(f"prepared{tmp_path.name}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        time.sleep(3)
        idle = sum(p["numInputRows"] == 0 for p in query.recentProgress)
    finally:
        query.stop()
        spark.conf.unset(sessions.STORE)
    return {(r["conv_id"], r["seq"]): r for r in spark.table(f"prepared{tmp_path.name}").collect()}, idle


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_streamed_prepares_equal_the_batch(spark, tmp_path):
    profile = Profile("p", Budget(100, 0.5, 0.8), WindowOptions(1, 0.2))
    first, second, want = [], [], {}
    for conv in range(3):
        talk = Conversation(profile)
        for seq in range(0, 12, 2):
            tokens = 10 + conv * 7 + seq
            row = (conv, seq, at(seq), "append", "Tool" if seq % 4 else "User", tokens, 5 if seq % 4 else None, False, None)
            (first if seq < 6 else second).extend([row, (conv, seq + 1, at(seq + 1), "prepare", None, None, None, None, None)])
            talk.append(*row[4:7])
            p = talk.prepare()
            want[conv, seq + 1] = (p["outcome"], p["error"], p["before"], p["after"], p["masked"], p["dropped"])
    second += [(0, 20, at(20), "close", None, None, None, None, None), (0, 21, at(21), "prepare", None, None, None, None, None), (1, 3, at(3), "append", "User", 500, None, False, None)]
    want[0, 21] = (None, "Closed", None, None, None, None)
    got, idle = run_stream(spark, tmp_path, [first, second], profile)
    assert {k: tuple(r)[2:] for k, r in got.items()} == want  # the late row of conversation 1 changes nothing
    assert idle <= 2


def test_idle_conversations_are_cleared(spark, tmp_path):
    profile = Profile("p", Budget(100, 0.5, 0.8), WindowOptions(1, 0.2))
    line = lambda seq, seconds, kind, conv=1: (conv, seq, at(seconds), kind, "User", 10, None, False, None)
    batches = [[line(0, 0, "append"), line(1, 1, "prepare")], [line(0, 500, "append", 2)], [line(0, 1000, "append", 2)], [line(2, 1001, "append"), line(3, 1002, "prepare")]]
    got, _ = run_stream(spark, tmp_path, batches, profile, idle_ms=60_000, lateness="1 second")
    assert (got[1, 1]["tokens_before"], got[1, 3]["tokens_before"]) == (10, 10)  # what was said before is forgotten


def test_state_store_is_checked(spark):
    from windrow.streaming import sessions

    with pytest.raises(ValueError, match="RocksDB"):
        sessions.prepare_stream(spark.readStream.format("rate").load(), Profile("p", Budget(100)))


def test_windowed_counts_and_written_transcripts(spark, tmp_path):
    from windrow.streaming import sessions

    events = [{"session": "s", "seq": i, "kind": "user_prompt", "exchange": i, "content": f"c{i}", "total_tokens": 1} for i in range(3)]
    frame = spark.read.schema(transcript.EVENTS).json(spark.sparkContext.parallelize(map(json.dumps, events))).withColumn("ts", F.timestamp_seconds(F.col("seq") * 400))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    counts = sessions.exchange_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "a")).start()
    written = sessions.write_transcripts(stream, str(tmp_path / "out"), str(tmp_path / "b"))
    for q in (counts, written):
        q.processAllAvailable()
        q.stop()
    assert sum(r["events"] for r in spark.table("counts").collect()) == 3
    assert "c2" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect())
