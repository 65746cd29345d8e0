"""Budgets, tokens, preparing and replaying, against the published cases and a sequential form."""

import random

import pytest
from pyspark.sql import functions as F

from windrow import schema
from windrow.functions.tokens import count_segments, message_tokens
from windrow.operators import compaction, history
from windrow.plans import anchor
from windrow.plans.budget import Budget, BudgetError, Profile, ProfileBuilder, ProfileRegistry, WindowOptions, placeholder_parts
from windrow.plans.points import prepare_points
from windrow.plans.prepare import prefixes, prepare


def log(spark, rows):
    """rows: (conv, idx, role, pinned, turn, tokens, segments); a segment is (kind, id, name, content)."""
    data = [(c, i, role, "Original", pinned, None, turn, tokens, segments) for c, i, role, pinned, turn, tokens, segments in rows]
    return spark.createDataFrame(data, schema.MESSAGES)


def text(content):
    return [("text", None, None, content)]


def result(call, content, name="t"):
    return [("tool_result", call, name, content)]


def test_estimates(spark):
    cases = [("😀😀", 5), ("😀" * 5, 7), ("", 4), ("abcde", 6)]
    rows = [(1, i, "User", False, 0, None, text(t)) for i, (t, _) in enumerate(cases)]
    rows += [(1, 10, "Tool", False, 0, None, result("call_1", "42", "calc")), (1, 11, "Model", False, 0, None, [("tool_use", "call_1", "calc", "{}")]), (1, 12, "User", False, 0, 0, text("abc")), (1, 13, "User", False, 0, 9, text("abc"))]
    got = {r[0]: (r[1], r[2]) for r in log(spark, rows).select("msg_idx", message_tokens(F.col("segments"), F.col("token_count")), count_segments(F.col("segments"), F.col("token_count"))).collect()}
    assert [got[i][0] for i in range(4)] == [t for _, t in cases]
    assert got[10][0] == 6 and got[11][0] == 6
    assert got[12] == (0, 5) and got[13] == (9, 9)


def test_budget():
    assert Budget(100, 0.29).compaction_trigger == 28
    assert Budget(1000).tolerance_tokens == 50 and Budget(1000).emergency_trigger is None
    for bad in ({"max_tokens": 0}, {"compaction": 0}, {"compaction": 0.9, "emergency": 0.9}, {"tolerance": 1.5}, {"emergency": float("nan")}):
        with pytest.raises(BudgetError):
            Budget(**bad)
    for bad in ({"size": 0}, {"fraction": 1.0}, {"placeholder": " "}, {"placeholder": "{2}"}, {"placeholder": "{0,x}"}):
        with pytest.raises(BudgetError):
            WindowOptions(**bad)
    assert placeholder_parts("a{{{1}}}b{0}{1}") == ["a{", 1, "}b", 0, 1]
    assert placeholder_parts("{0,-8}|{1, 4}") == [(0, -8), "|", (1, 4)]
    with pytest.raises(BudgetError):
        ProfileBuilder().build()
    built = ProfileBuilder.default(50).with_compaction(0.5).with_emergency(0.9).build()
    assert (built.budget.max_tokens, built.budget.emergency_trigger) == (50, 45)
    registry = ProfileRegistry().register(built, "a").register(Profile("x", Budget(7)), "a")
    assert registry.get("a").budget.max_tokens == 7
    with pytest.raises(KeyError):
        registry.get("b")


@pytest.mark.parametrize(("tokens", "size", "share", "masked", "before"), [([7, 1, 1, 1, 1], 2, 0.5, [0], 11), ([4, 4, 4, 4, 4], 4, 0.2, [0], 20)])
def test_protected_tail(spark, tokens, size, share, masked, before):
    rows = [(1, i, "Tool", False, 0, t, result(f"c{i}", "x")) for i, t in enumerate(tokens)]
    done = prepare(log(spark, rows), [Profile("p", Budget(10, 0.01), WindowOptions(size, share))])
    assert [r["msg_idx"] for r in done.rows.filter("is_masked").orderBy("msg_idx").collect()] == masked
    row = done.results.first()
    assert row["strategy_before"] == before and row["masked"] == 1


def test_names_last_call_wins_and_unknown_keeps_its_id(spark):
    rows = [
        (1, 0, "Model", False, 1, None, [("tool_use", "a", "first", "{}"), ("tool_use", "a", "second", "{}")]), (1, 1, "Tool", False, 1, None, result("a", "x" * 90)),
        (1, 2, "Tool", False, 1, None, result("b", "y" * 90, "given")), (1, 3, "Model", True, 1, None, [("tool_use", "b", "pinned", "{}")]), (1, 4, "User", False, 1, None, text("hi")),
    ]
    done = prepare(log(spark, rows), [Profile("p", Budget(100, 0.1), WindowOptions(1, 0.01, "<{1}|{0}>"))]).messages()
    got = {r["msg_idx"]: r["segments"][0] for r in done.collect()}
    assert (got[1]["tool_name"], got[1]["content"]) == ("second", "<a|second>")
    assert (got[2]["tool_name"], got[2]["content"]) == ("b", "<b|b>")
    assert got[2]["tool_call_id"] == "b"


def test_emergency_with_anchor(spark):
    rows = [(1, i, "Model", False, i, t, text("x")) for i, t in enumerate((150, 500, 550))]
    done = prepare(log(spark, rows), [Profile("p", Budget(1000, 0.5, 1.0))], spark.createDataFrame([(1, -100)], "conv_id long, correction long"))
    row = done.results.first()
    assert (row["outcome"], row["tokens_after"], row["dropped"], row["reason"]) == ("Compacted", 950, 1, None)
    event = done.events().first()
    assert (event["trigger_kind"], event["tokens_before"], event["tokens_after"]) == ("Emergency", 1200, 950)


def test_orphans_by_default_and_strict_floor(spark):
    rows = [(1, 0, "User", False, 0, 50, text("u")), (1, 1, "Model", False, 1, 50, [("tool_use", "a", "t", "{}")]), (1, 2, "Tool", False, 1, 900, result("a", "x"))]
    profile = [Profile("p", Budget(1000, 0.5, 0.9), WindowOptions(5, 0.5))]
    dropped = lambda strict: {r["msg_idx"] for r in prepare(log(spark, rows), profile, strict_floor=strict).rows.filter("is_dropped").collect()}
    assert dropped(False) == {0, 1}
    assert dropped(True) == {0}


def test_pinned_overflow_all_pinned_and_outcomes(spark):
    rows = [(1, 0, "System", True, 0, 101, text("s")), (2, 0, "System", True, 0, 90, text("s")), (3, 0, "User", False, 0, 500, text("s")), (4, 0, "User", False, 0, 5, text("s"))]
    got = {r["conv_id"]: r for r in prepare(log(spark, rows), [Profile("p", Budget(100, 0.5, 0.6))]).results.collect()}
    assert got[1]["error"] == "PinnedTokenBudgetExceeded" and got[1]["outcome"] is None
    assert got[2]["outcome"] == "Ready" and got[2]["dropped"] == 0
    assert got[3]["outcome"] == "ContextExhausted" and "500 tokens > 105 max" in got[3]["reason"]
    assert got[4]["outcome"] == "Ready"


def test_set_based_equals_sequential(spark):
    r = random.Random(1)
    profiles = [Profile("a", Budget(120, 0.5, 0.7), WindowOptions(2, 0.3)), Profile("b", Budget(200, 0.4), WindowOptions(3, 0.5)), Profile("c", Budget(60, 0.3, 0.9, 0.2), WindowOptions(1, 0.2))]
    rows = []
    for conv in range(120):
        turn = 0
        for i in range(r.randint(1, 12)):
            role = "System" if i == 0 and r.random() < 0.4 else r.choice(["User", "Model", "Tool"])
            turn += role == "Model"
            segments = result(f"c{i}", "z" * r.randint(0, 200)) if role == "Tool" else text("w" * r.randint(1, 120))
            rows.append((conv, i, role, role == "System" or r.random() < 0.1, turn, r.choice([None, r.randint(0, 60)]), segments))
    messages = log(spark, rows)
    done = prepare(messages, profiles)
    narrow = [x.asDict() for x in compaction.measured(messages, WindowOptions().placeholder).orderBy("conv_id", "msg_idx").collect()]
    got = {(x["profile"], x["conv_id"]): x for x in done.results.collect()}
    kept = {}
    for x in done.rows.filter("NOT is_dropped").collect():
        kept.setdefault((x["profile"], x["conv_id"]), set()).add(x["msg_idx"])
    for profile in profiles:
        for conv in range(120):
            want = anchor.sequential((x for x in narrow if x["conv_id"] == conv), profile)
            row = got[profile.name, conv]
            assert (row["outcome"], row["error"], row["tokens_before"], row["masked"], row["dropped"]) == (want["outcome"], want["error"], want["before"], want["masked"], want["dropped"]), (profile.name, conv)
            if want["error"] is None:
                assert row["tokens_after"] == want["after"] and kept.get((profile.name, conv), set()) == set(want["kept"])


def test_strategies_keep_their_rows_where_there_are_pinned_ones(spark):
    rows = [(conv, i, "System" if conv == 1 and i == 0 else "User", conv == 1 and i == 0, 0, 20, text("x")) for conv in (1, 2) for i in range(4)]
    profile = [Profile("p", Budget(100, 0.5, None, 0.5))]
    kept = lambda rows: compaction.mask(compaction.protect(rows))
    fewer = lambda rows: kept(rows).filter("msg_idx <> 2")
    renamed = lambda rows: kept(rows).withColumn("msg_idx", F.when(F.col("msg_idx") == 2, 9).otherwise(F.col("msg_idx")))
    errors = lambda strategy: {r["conv_id"]: r["error"] for r in prepare(log(spark, rows), profile, strategy=strategy).results.collect()}
    assert errors(kept) == {1: None, 2: None}
    assert errors(fewer) == errors(renamed) == {1: "StrategyChangedRows", 2: None}


def test_prefixes_keep_large_ids_and_indexes_apart(spark):
    rows = [(conv, i, "Model" if i == 1_000_001 else "User", False, 0, 5, text("x")) for conv in (2**60, 2**60 + 1) for i in (0, 1_000_000, 1_000_001)]
    points = prefixes(log(spark, rows))
    assert sorted((r["conv_id"]["conv_id"], r["conv_id"]["point"], r["n"]) for r in points.groupBy("conv_id").agg(F.count("*").alias("n")).collect()) == [(2**60, 1_000_001, 2), (2**60 + 1, 1_000_001, 2)]
    assert prepare(points, [Profile("p", Budget(100))]).results.count() == 2


def test_prepare_points_equal_the_prefixes(spark):
    r = random.Random(7)
    profiles = [
        Profile("a", Budget(120, 0.5, 0.7), WindowOptions(2, 0.3)), Profile("b", Budget(200, 0.4), WindowOptions(3, 0.5)), Profile("c", Budget(60, 0.3, 0.9, 0.2), WindowOptions(1, 0.2)),
        Profile("d", Budget(300, 0.05, 0.1), WindowOptions(1, 0.05)),
    ]
    rows = []
    for conv in range(80):
        turn = 0
        for i in range(r.randint(1, 24)):
            role = "System" if i == 0 and r.random() < 0.4 else r.choice(["User", "Model", "Tool", "Model"])
            turn += r.random() < 0.5
            call = f"c{r.randint(0, 9) if conv % 4 == 0 else i}"  # in a quarter of them calls take ids anew
            segments = result(call, "z" * r.randint(0, 200)) if role == "Tool" else text("w" * r.randint(1, 120))
            if role == "Model" and conv % 4 == 0:
                segments = segments + [("tool_use", call, "n" * r.randint(1, 60), "{}")]
            rows.append((conv, i * 3, role, role == "System" or r.random() < 0.1, r.choice([turn, turn, None]), r.choice([None, 0, r.randint(0, 60)]), segments))
    messages = log(spark, rows)
    want = prepare(prefixes(messages), profiles).results.withColumn("point", F.col("conv_id.point")).withColumn("conv_id", F.col("conv_id.conv_id"))
    got = prepare_points(messages, profiles)
    order = ["profile", "conv_id", "point"]
    want, got = ([x.asDict() for x in df.select(*sorted(df.columns)).orderBy(*order).collect()] for df in (want, got))
    assert len(got) > 1000 and {x["outcome"] for x in got} == {None, "Ready", "Compacted", "Degraded", "ContextExhausted"}
    assert compaction.called_later(messages).count() > 5
    for one, other in zip(want, got, strict=True):
        assert one == other


def test_turns(spark):
    rows = [(1, 0, "append"), (1, 1, "prepare"), (1, 2, "prepare"), (1, 3, "append"), (1, 4, "append"), (1, 5, "prepare"), (1, 6, "append")]
    got = history.stamp_turns_from_log(spark.createDataFrame(rows, "conv_id long, seq long, kind string")).orderBy("seq").collect()
    assert [x["turn"] for x in got] == [0, 1, 1, 2]


def test_anchor_keeps_the_residual(spark):
    points = spark.createDataFrame([(1, i, raw, raw, seen) for i, (raw, seen) in enumerate(((100, 120), (150, 180), (200, 240), (250, 300)))], "conv_id long, seq long, raw long, raw_final long, provider long")
    profile = Profile("p", Budget(10_000))
    assert [x["corr"] for x in anchor.replay(points, profile).orderBy("seq").collect()] == [0, 20, 10, 30]
    assert [x["corr"] for x in anchor.replay(points, profile, cumulative=True).orderBy("seq").collect()] == [0, 20, 30, 40]


def test_anchor_goes_on_over_batches_and_starts_anew_with_each_conversation(spark):
    # each conversation is longer than an Arrow batch; adding up keeps a correction of 3 to its end
    points = spark.range(0, 60_000).selectExpr("id % 3 AS conv_id", "id AS seq", "100 + id AS raw", "100 + id AS raw_final", "IF(id < 6, 103 + id, NULL) AS provider")
    got = anchor.replay(points, Profile("p", Budget(10_000_000)))
    # the second report equals the corrected estimate, so nothing of the drift is left
    assert got.filter("corr <> CASE WHEN seq < 3 THEN 0 WHEN seq < 6 THEN 3 ELSE 0 END").isEmpty() and got.count() == 60_000
    cumulative = anchor.replay(points, Profile("p", Budget(10_000_000)), cumulative=True)
    assert cumulative.filter("corr <> CASE WHEN seq < 3 THEN 0 ELSE 3 END OR final <> total OR NOT ready").isEmpty()
    gaps = spark.createDataFrame([(None, 1, None, None, 7), (None, 2, 5, 5, None), (2**60, 1, 5, 5, None)], "conv_id long, seq long, raw long, raw_final long, provider long")
    assert sorted((str(x["conv_id"]), x["seq"], x["total"], x["corr"]) for x in anchor.replay(gaps, Profile("p", Budget(1000))).collect()) == [(str(2**60), 1, 5, 0), ("None", 1, 0, 0), ("None", 2, 12, 7)]


def test_anchor_fold_equals_the_sequential_form(spark):
    r = random.Random(5)
    profile = Profile("p", Budget(400, 0.5), WindowOptions(1, 0.1))
    rows, points = [], []
    for conv in range(30):
        talk = anchor.Conversation(profile)
        for i in range(12):
            role, tokens, seen = ("Model", 30, r.choice([None, r.randint(50, 400)])) if i % 3 == 1 else ("User", r.randint(1, 60), None)
            if role == "Model":
                p = talk.prepare()
                raw = sum(x["tokens"] for x in talk.rows)
                points.append((conv, i, raw, raw, seen, p["before"], p["after"], p["corr"]))
            talk.append(role, tokens, None, False, seen)
            rows.append((conv, i, role, False, tokens, None, seen))
    frame = spark.createDataFrame(points, "conv_id long, seq long, raw long, raw_final long, provider long, want_total long, want_final long, want_corr long")
    got = anchor.replay(frame, profile).join(frame, ["conv_id", "seq"])
    assert got.filter("total <> want_total OR final <> want_final OR corr <> want_corr").isEmpty() and got.count() == len(points)
    narrow = spark.createDataFrame(rows, "conv_id long, msg_idx int, role string, is_pinned boolean, tokens long, masked_tokens long, provider long")
    other = anchor.replay_with_emergency(narrow, profile).join(frame, ["conv_id", "seq"])
    assert other.filter("total <> want_total OR final <> want_final OR corr <> want_corr").isEmpty() and other.count() == len(points)


def test_violations(spark):
    rows = [(1, 0, "User", False, 0, None, []), (1, 1, "Robot", False, 0, None, text("\u2003 ")), (1, 2, "Tool", False, 0, None, [("tool_result", "a", " ", "")]), (1, 3, "Model", False, 0, None, [("tool_use", "a", "b", "{}")])]
    got = {(x["msg_idx"], x["rule"]) for x in schema.violations(log(spark, rows)).collect()}
    assert got == {(0, "no_segments"), (1, "role_unknown"), (1, "text_blank"), (2, "tool_name_blank")}


def test_upsert_replaces_in_place_or_inserts(spark):
    rows = [(1, 0, "User", False, 3, None, text("u")), (1, 1, "System", False, 3, None, text("old")), (2, 0, "User", False, 4, None, text("u"))]
    prompts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "conv_id long, seq long, text string")
    got = [(x["conv_id"], x["msg_idx"], x["role"], x["is_pinned"], x["turn"], x["segments"][0]["content"]) for x in history.upsert_system_prompts(log(spark, rows), prompts).orderBy("conv_id", "msg_idx").collect()]
    assert got == [(1, 0, "User", False, 3, "u"), (1, 1, "System", True, 0, "b"), (2, 0, "System", True, 4, "c"), (2, 1, "User", False, 4, "u")]


def test_placeholder_widths(spark):
    from windrow.plans.budget import placeholder

    say = lambda template: spark.range(1).select(placeholder(template, F.lit("tool"), F.lit("c1"))).first()[0]
    assert [say(t) for t in ("{0,-6}|{1,4}|", "{0,2}{1}", "{{{0}}}")] == ["tool  |  c1|", "toolc1", "{tool}"]


def test_empty_log(spark):
    done = prepare(log(spark, []), [Profile("p", Budget(10))])
    assert done.results.count() == 0 and done.messages().count() == 0 and done.events().count() == 0
    assert prepare_points(log(spark, []), [Profile("p", Budget(10))]).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_emergency_replay_equals_the_sequential_form(spark, seed):
    r = random.Random(seed)
    profile = Profile("p", Budget(400, 0.4, r.choice([0.5, 0.7, None]), r.choice([0, 0.1])), WindowOptions(r.choice([1, 3]), r.choice([0.1, 0.3])))
    rows, want = [], {}
    for conv in range(40):
        talk = anchor.Conversation(profile)
        for i in range(r.randint(1, 40)):
            role = r.choice(["User", "Model", "Model", "Tool", "Tool"]) if i or conv % 2 else "User"
            tokens, masked, pinned = r.randint(0, 60), None, r.random() < 0.06
            if role == "Tool":
                masked = r.choice([None, 3, tokens + 5])
            seen = r.choice([None, r.randint(20, 500)]) if role == "Model" else None
            if role == "Model":
                p = talk.prepare()
                want[conv, i] = (p["before"], p["after"], p["corr"], p["masked"], p["dropped"], p["outcome"])
            talk.append(role, tokens, masked, pinned, seen)
            rows.append((conv, i, role, pinned, tokens, masked, seen))
    frame = spark.createDataFrame(rows, "conv_id long, msg_idx int, role string, is_pinned boolean, tokens long, masked_tokens long, provider long").repartition(5)
    got = {(x.conv_id, x.seq): tuple(x)[2:] for x in anchor.replay_with_emergency(frame, profile).collect()}
    assert got == want
    assert seed != 0 or {x[-1] for x in want.values()} >= {"Ready", "Compacted"} and any(x[4] for x in want.values())
