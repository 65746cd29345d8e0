"""DuckDB equivalents of the queries, written from the definitions of the operators."""

from __future__ import annotations


def u16(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


PROFILES = [
    ("p1", 4000, 0.5, 0.6, 3, 0.3), ("p2", 2000, 0.5, 0.8, 2, 0.3), ("p3", 2000, 0.5, None, 2, 0.3), ("p4", 1000, 0.5, 0.8, 2, 0.3),
    ("p5", 2000, 0.8, None, 10, 0.8), ("p6", 60, 0.5, 0.8, 2, 0.3),
]

MESSAGES = f"""
src AS (
  SELECT conv_id, turn AS spot, 0 AS part, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Model' END AS role, text,
    CASE WHEN role NOT IN ('system', 'user') THEN (conv_id * 31 + turn) % (SELECT count(*) FROM pages) END AS page FROM conversations),
every AS (
  SELECT conv_id, spot, part, role, text, 'call_' || conv_id || '_' || spot AS call_id, '{{"page_id":' || page || '}}' AS args, NULL::VARCHAR AS result FROM src
  UNION ALL SELECT conv_id, spot, 1, 'Tool', NULL::VARCHAR, 'call_' || conv_id || '_' || spot, NULL::VARCHAR, html FROM src JOIN pages ON page = page_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spot, part) - 1 AS msg_idx, role = 'System' AS is_pinned FROM every),
msgs AS (
  SELECT conv_id, msg_idx, role, is_pinned, text, CASE WHEN role IN ('Model', 'Tool') THEN call_id END AS call_id, args, result,
    sum((role = 'Model')::INT) OVER (PARTITION BY conv_id ORDER BY msg_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS turn,
    ceil(CASE role WHEN 'Model' THEN {u16('text')} + 9 + length(args) WHEN 'Tool' THEN length(call_id) + {u16('result')} ELSE {u16('text')} END / 4.0::DOUBLE)::BIGINT + 4 AS tokens,
    CASE WHEN role = 'Tool' THEN ceil((length(call_id) + length('[Tool result cleared — web_fetch, ' || call_id || ']')) / 4.0::DOUBLE)::BIGINT + 4 END AS masked_tokens
  FROM placed)
"""


def ratios(names: list[str]) -> str:
    rows = ", ".join(f"('{n}', {c}::DOUBLE, {'NULL' if e is None else e}::DOUBLE)" for n, _, c, e, _, _ in PROFILES if n in names)
    return f"ratio(profile, soft, hard) AS (VALUES {rows})"


def profile_rows(names: list[str], source: str = "msgs", tolerance: float = 0.05) -> str:
    rows = ", ".join(
        f"('{n}', {m}, floor({m} * {c}::DOUBLE)::BIGINT, {'NULL::BIGINT' if e is None else f'floor({m} * {e}::DOUBLE)::BIGINT'}, floor({m} * {tolerance}::DOUBLE)::BIGINT, {w}, {f}::DOUBLE)"
        for n, m, c, e, w, f in PROFILES if n in names
    )
    return f"""
prof(profile, max_tokens, trigger, emergency, tolerance, wsize, fraction) AS (VALUES {rows}),
p1 AS (
  SELECT *, sum(tokens) OVER w AS total, coalesce(sum(tokens) FILTER (is_pinned) OVER w, 0) AS pinned,
    row_number() OVER (PARTITION BY profile, conv_id, is_pinned ORDER BY msg_idx DESC) AS rn,
    sum(tokens) OVER (PARTITION BY profile, conv_id, is_pinned ORDER BY msg_idx DESC ROWS UNBOUNDED PRECEDING) AS newer
  FROM {source} CROSS JOIN prof WINDOW w AS (PARTITION BY profile, conv_id)),
p2 AS (
  SELECT *, total < trigger AS is_ready, pinned > max_tokens AS failed,
    NOT is_pinned AND (rn <= wsize OR newer <= floor((max_tokens - pinned)::DOUBLE * fraction)) AS is_protected FROM p1),
p3 AS (SELECT *, NOT (is_pinned OR is_protected OR is_ready OR failed OR masked_tokens IS NULL) AS is_masked FROM p2),
p4 AS (
  SELECT *, CASE WHEN is_masked THEN masked_tokens ELSE tokens END AS cost,
    max(role) FILTER (NOT is_pinned AND rn = 1) OVER w AS role1, max(msg_idx) FILTER (NOT is_pinned AND rn = 1) OVER w AS idx1,
    max(role) FILTER (NOT is_pinned AND rn = 2) OVER w AS role2, max(msg_idx) FILTER (NOT is_pinned AND rn = 2) OVER w AS idx2, count(*) OVER w AS n_rows
  FROM p3 WINDOW w AS (PARTITION BY profile, conv_id)),
p5 AS (
  SELECT *, coalesce(CASE WHEN role1 = 'Model' AND role2 = 'User' THEN idx2 ELSE idx1 END, n_rows) AS floor_idx, sum(cost) OVER (PARTITION BY profile, conv_id) AS prepared,
    lag(turn) OVER o AS last_turn, lag(is_pinned) OVER o AS last_pinned FROM p4 WINDOW o AS (PARTITION BY profile, conv_id ORDER BY msg_idx)),
p6 AS (SELECT *, NOT is_pinned AND msg_idx < floor_idx AS droppable FROM p5),
p7 AS (
  SELECT *, CASE WHEN droppable THEN sum((droppable AND (coalesce(last_pinned, true) OR turn <> last_turn))::INT)
    OVER (PARTITION BY profile, conv_id ORDER BY msg_idx ROWS UNBOUNDED PRECEDING) END AS turn_group FROM p6),
groups AS (
  SELECT profile, conv_id, turn_group, sum(cost) AS group_cost,
    coalesce(sum(sum(cost)) OVER (PARTITION BY profile, conv_id ORDER BY turn_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM p7 WHERE turn_group IS NOT NULL GROUP BY profile, conv_id, turn_group),
decided AS (
  SELECT p7.*, coalesce(NOT is_ready AND NOT failed AND prepared - earlier > emergency, false) AS is_dropped
  FROM p7 LEFT JOIN groups USING (profile, conv_id, turn_group)),
results AS (
  SELECT profile, conv_id, any_value(max_tokens) AS max_tokens, any_value(tolerance) AS tolerance, any_value(total)::BIGINT AS tokens_before,
    CASE WHEN any_value(failed) THEN 'PinnedTokenBudgetExceeded' END AS error, any_value(is_ready) AS is_ready,
    count(*) FILTER (is_masked) AS masked, count(*) FILTER (is_dropped) AS dropped, coalesce(sum(cost) FILTER (NOT is_dropped), 0)::BIGINT AS tokens_after,
    coalesce(sum(tokens) FILTER (NOT is_pinned), 0)::BIGINT AS strategy_before, coalesce(sum(cost) FILTER (NOT is_pinned), 0)::BIGINT AS strategy_after
  FROM decided GROUP BY profile, conv_id),
labelled AS (
  SELECT *, masked + dropped AS compacted, CASE WHEN error IS NOT NULL THEN NULL WHEN is_ready THEN 'Ready'
    WHEN tokens_after <= max_tokens + tolerance THEN CASE WHEN masked + dropped > 0 THEN 'Compacted' ELSE 'Ready' END
    WHEN masked + dropped = 0 THEN 'ContextExhausted' ELSE 'Degraded' END AS outcome FROM results)
"""


ALL = [p[0] for p in PROFILES]
PREPARED = "WITH " + MESSAGES + "," + profile_rows(["p2"])
SWEEP = "WITH " + MESSAGES + "," + profile_rows(ALL)
PREFIX_SOURCE = (
    MESSAGES
    + """,
prefixed AS (
  SELECT m.conv_id * 1000000 + p.msg_idx AS conv_id, m.conv_id AS source_conv_id, p.msg_idx AS point, m.* EXCLUDE (conv_id)
  FROM msgs m JOIN msgs p ON m.conv_id = p.conv_id AND p.role = 'Model' AND m.msg_idx < p.msg_idx)
"""
)


def prefixed(names: list[str], recursive: str = "") -> str:
    return f"WITH {recursive} " + PREFIX_SOURCE + "," + profile_rows(names, "prefixed")


#: The turn table that the audit works on: what the transcripts of all prepare points say.
TURNS = (
    prefixed(["p2"])
    + """,
turns AS (
  SELECT conv_id // 1000000 AS session, row_number() OVER (PARTITION BY conv_id // 1000000 ORDER BY conv_id) - 1 AS turn, tokens_before AS before, tokens_after AS after,
    outcome, compacted, CASE WHEN (conv_id // 1000000 + conv_id % 1000000) % 5 <> 0 THEN tokens_after + floor(((conv_id // 1000000 + conv_id % 1000000) % 7 - 3) * tokens_after / 20.0::DOUBLE)::BIGINT END AS input FROM labelled WHERE outcome IS NOT NULL)
"""
)

AUDIT = (
    TURNS
    + """,
seen AS (SELECT *, lag(before) OVER w AS p_before, lag(compacted) OVER w AS p_compacted FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn)),
found AS (
  SELECT session, turn, 'history_shrank' AS invariant, before AS observed, p_before AS expected, 1 AS severity FROM seen WHERE before < p_before
  UNION ALL SELECT session, turn, 'over_window', input, 2000, 0 FROM seen WHERE input > 2000
  UNION ALL SELECT session, turn, 'estimate_off', input, after, 2 FROM seen WHERE abs(input - after) * 10 > after
  UNION ALL SELECT session, turn, 'compacted_fell', compacted, p_compacted, 1 FROM seen WHERE compacted < p_compacted
  UNION ALL SELECT session, turn, 'compacted_jumped', compacted, p_compacted, 3 FROM seen WHERE compacted - p_compacted > 20
  UNION ALL SELECT session, turn, 'compaction_useless', after, before, 1 FROM seen WHERE outcome = 'Compacted' AND after >= before
  UNION ALL SELECT session, turn, 'reported_far_below', input, after, 2 FROM seen WHERE (after - input) * 100 > after * 15)
"""
)

SESSIONS = """
WITH stems AS (
  SELECT strftime(to_timestamp(conv_id % 50) AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S000') || '-Owner_My_repo-what_' || conv_id % 2 AS stem FROM conversations WHERE turn = 0),
numbered AS (SELECT stem, row_number() OVER (PARTITION BY stem) AS nth FROM stems),
named AS (SELECT stem || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END || '.md' AS log_name FROM numbered)
"""

LINES = r"""
WITH lines AS (
  SELECT 'doc/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
near AS (SELECT *, lag(line) OVER w AS previous, lead(line) OVER w AS next FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no)),
hits AS (
  SELECT *, row_number() OVER (ORDER BY upper(path), path, line_no) AS n, count(*) OVER () AS matches FROM near WHERE regexp_matches(line, 'password|token'))
"""

EXCHANGES = """
WITH exchanges AS (
  SELECT conv_id AS session, turn AS exchange, (conv_id + turn) % 4 - 1 AS turns, text, CASE (conv_id + turn) % 5 WHEN 0 THEN 'reply' WHEN 1 THEN 'degraded' WHEN 2 THEN 'max_turns' WHEN 3 THEN 'cancelled' ELSE 'failed' END AS kind
  FROM conversations)
"""

FILES = """
WITH files AS (
  SELECT source || '/' || lang || '/Doc-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.MD' ELSE '.txt' END AS path, strlen(text) AS length FROM documents)
"""

ORACLE_SQL = {
    "message_token_estimate": "WITH " + MESSAGES + "SELECT conv_id, msg_idx, role, tokens FROM msgs",
    "conversation_token_total": "WITH " + MESSAGES + "SELECT conv_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens FROM msgs GROUP BY conv_id",
    "segment_char_count": "WITH " + MESSAGES + f"""
SELECT conv_id, msg_idx, 0 AS seg, CASE WHEN role = 'Tool' THEN 'tool_result' ELSE 'text' END AS kind,
  CASE WHEN role = 'Tool' THEN length(call_id) + {u16('result')} ELSE {u16('text')} END AS chars FROM msgs
UNION ALL SELECT conv_id, msg_idx, 1, 'tool_use', 9 + length(args) FROM msgs WHERE role = 'Model'""",
    "pinned_token_total": "WITH " + MESSAGES + "SELECT conv_id, coalesce(sum(tokens) FILTER (is_pinned), 0)::BIGINT AS pinned FROM msgs GROUP BY conv_id",
    "budget_derived_thresholds": "WITH " + ratios(ALL) + """
SELECT DISTINCT conv_id, profile, 1000 + 500 * (conv_id % 7) AS max_tokens, floor((1000 + 500 * (conv_id % 7)) * soft)::BIGINT AS trigger, floor((1000 + 500 * (conv_id % 7)) * hard)::BIGINT AS emergency,
  floor((1000 + 500 * (conv_id % 7)) * 0.05::DOUBLE)::BIGINT AS tolerance FROM conversations CROSS JOIN ratio""",
    "turn_stamping": "WITH " + MESSAGES + "SELECT conv_id, msg_idx, role, turn FROM msgs",
    "system_prompt_upsert": "WITH " + MESSAGES + """,
prompts AS (SELECT DISTINCT conv_id, 'Prompt B of ' || conv_id AS prompt FROM conversations WHERE conv_id % 3 = 0),
slots AS (SELECT conv_id, min(msg_idx) AS slot FROM msgs WHERE role = 'System' GROUP BY conv_id),
ends AS (SELECT conv_id, arg_max(turn, msg_idx) AS now FROM msgs GROUP BY conv_id),
seen AS (SELECT m.*, prompt, slot, prompt IS NOT NULL AND msg_idx = slot AS hit FROM msgs m LEFT JOIN prompts USING (conv_id) LEFT JOIN slots USING (conv_id))
SELECT conv_id, msg_idx + (prompt IS NOT NULL AND slot IS NULL)::INT AS msg_idx, role, is_pinned, CASE WHEN hit THEN 0 ELSE turn END AS turn,
  CASE WHEN hit THEN prompt ELSE coalesce(text, '') END AS text FROM seen
UNION ALL SELECT conv_id, 0, 'System', true, now, prompt FROM prompts JOIN ends USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM slots)""",
    "history_append": "WITH " + MESSAGES + """
SELECT conv_id, msg_idx, role, tokens FROM msgs
UNION ALL SELECT conv_id, count(*) + k AS msg_idx, 'User', ceil(length('later ' || k) / 4.0::DOUBLE)::BIGINT + 4 FROM msgs CROSS JOIN (VALUES (0), (1)) t(k) WHERE conv_id % 2 = 0 GROUP BY conv_id, k""",
    "threshold_trigger": SWEEP + "SELECT DISTINCT profile, conv_id, total::BIGINT AS total, NOT is_ready AS triggered FROM p2",
    "pinned_overflow": SWEEP + "SELECT profile, conv_id, error FROM labelled WHERE error IS NOT NULL",
    "pinned_split": "WITH " + MESSAGES + "SELECT conv_id, count(*) FILTER (is_pinned) AS pinned, count(*) FILTER (NOT is_pinned) AS compactable, min(msg_idx) FILTER (NOT is_pinned) AS first_compactable FROM msgs GROUP BY conv_id",
    "protected_tail": PREPARED + "SELECT conv_id, msg_idx, is_protected FROM p2",
    "tool_name_lookup": "WITH " + MESSAGES + "SELECT conv_id, call_id AS tool_call_id, 'web_fetch' AS tool_name FROM msgs WHERE role = 'Model'",
    "mask_tool_results": PREPARED + "SELECT conv_id, msg_idx, '[Tool result cleared — web_fetch, ' || call_id || ']' AS content, masked_tokens AS prepared_tokens FROM decided WHERE is_masked AND NOT is_dropped",
    "mask_token_delta": PREPARED + "SELECT conv_id, msg_idx, tokens, cost, cost - tokens AS delta FROM decided WHERE is_masked",
    "preserved_floor": SWEEP + "SELECT DISTINCT profile, conv_id, floor_idx AS floor FROM p6",
    "turn_groups": PREPARED + "SELECT conv_id, turn_group, count(*) AS messages, sum(cost)::BIGINT AS tokens, min(msg_idx) AS first_idx FROM p7 WHERE turn_group IS NOT NULL GROUP BY conv_id, turn_group",
    "emergency_drop": SWEEP + "SELECT profile, conv_id, msg_idx FROM decided WHERE is_dropped",
    "prepared_messages": PREPARED + f"""
SELECT conv_id, msg_idx, role, CASE WHEN is_masked THEN 'Masked' ELSE 'Original' END AS state, cost AS prepared_tokens,
  {u16("CASE WHEN role <> 'Tool' THEN text WHEN is_masked THEN '[Tool result cleared — web_fetch, ' || call_id || ']' ELSE result END")} AS chars
FROM decided WHERE NOT failed AND NOT is_dropped""",
    "prepare_results": PREPARED + "SELECT conv_id, outcome, error, tokens_before, tokens_after, masked, dropped, compacted FROM labelled",
    "outcome_distribution": SWEEP + "SELECT profile, outcome, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY profile) AS share FROM labelled GROUP BY profile, outcome",
    "degradation_reason": SWEEP + """
SELECT profile, conv_id, CASE outcome WHEN 'ContextExhausted' THEN
  'A single message or structural content exceeds the budget (' || tokens_after || ' tokens > ' || (max_tokens + tolerance) || ' max). Compaction is impossible.'
  ELSE 'Compaction reduced content but still exceeds budget (' || tokens_after || ' tokens > ' || (max_tokens + tolerance) || ' max). ' || compacted || ' messages were compacted but insufficient.' END AS reason
FROM labelled WHERE outcome IN ('ContextExhausted', 'Degraded')""",
    "compaction_events": SWEEP + """
SELECT profile, conv_id, CASE WHEN dropped > 0 THEN 'Emergency' ELSE 'Normal' END AS trigger_kind, strategy_before AS tokens_before,
  CASE WHEN dropped > 0 THEN tokens_after ELSE strategy_after END AS tokens_after, CASE WHEN dropped > 0 THEN compacted ELSE masked END AS affected, dropped
FROM labelled WHERE error IS NULL AND (dropped > 0 OR masked > 0)""",
    "profile_sweep": SWEEP + """
SELECT profile, count(*) FILTER (outcome = 'Ready') AS ready, count(*) FILTER (outcome = 'Compacted') AS compacted, count(*) FILTER (outcome = 'Degraded') AS degraded,
  count(*) FILTER (outcome = 'ContextExhausted') AS exhausted, count(*) FILTER (error IS NOT NULL) AS errors,
  sum(masked)::BIGINT AS masked, sum(dropped)::BIGINT AS dropped FROM labelled GROUP BY profile""",
    "overrun_tolerance_effect": "WITH " + MESSAGES + "," + profile_rows(ALL, tolerance=0.5) + "SELECT profile, outcome, count(*) AS n FROM labelled GROUP BY profile, outcome",
    "openai_projection": PREPARED + """
SELECT conv_id, msg_idx, CASE role WHEN 'Model' THEN 'assistant' ELSE lower(role) END AS role,
  md5(CASE WHEN role <> 'Tool' THEN text WHEN is_masked THEN '[Tool result cleared — web_fetch, ' || call_id || ']' ELSE result END) AS content,
  CASE WHEN role = 'Model' THEN call_id || ' web_fetch ' || args ELSE '' END AS calls, CASE WHEN role = 'Tool' THEN call_id END AS tool_call_id
FROM decided WHERE NOT failed AND NOT is_dropped""",
    "anthropic_projection": PREPARED + """
SELECT conv_id, msg_idx, CASE role WHEN 'Model' THEN 'assistant' ELSE 'user' END AS role, CASE role WHEN 'Model' THEN 'text,tool_use' WHEN 'Tool' THEN 'tool_result' ELSE 'text' END AS kinds,
  CASE WHEN role = 'Model' THEN json_extract_string(args, '$.page_id') END AS page, NULL::VARCHAR AS error
FROM decided WHERE NOT failed AND NOT is_dropped AND role <> 'System'""",
    "anthropic_system_blocks": "WITH " + MESSAGES + "SELECT conv_id, count(*) AS blocks, string_agg(text, chr(10) ORDER BY msg_idx) AS system FROM msgs WHERE role = 'System' GROUP BY conv_id",
    "first_text_segment": "WITH " + MESSAGES + "SELECT conv_id, msg_idx, md5(coalesce(text, '')) AS text FROM msgs",
    "orphan_tool_results": SWEEP + """
SELECT t.profile, t.conv_id, t.msg_idx FROM decided t JOIN decided m ON t.profile = m.profile AND t.conv_id = m.conv_id AND t.call_id = m.call_id AND m.role = 'Model'
WHERE t.role = 'Tool' AND NOT t.is_dropped AND m.is_dropped""",
    "anchor_replay": prefixed(["p3"], "RECURSIVE") + """,
points AS (
  SELECT conv_id // 1000000 AS c, conv_id % 1000000 AS seq, tokens_before AS raw, tokens_after AS raw_final, CASE WHEN (conv_id // 1000000 + conv_id % 1000000) % 3 > 0 THEN tokens_before + (conv_id // 1000000 + conv_id % 1000000) % 41 END AS provider,
    row_number() OVER (PARTITION BY conv_id // 1000000 ORDER BY conv_id) AS n FROM labelled),
-- tokens_after of a prefix below the trigger is its raw count, which compaction would not change without tool results to mask
fold AS (
  SELECT c, seq, n, raw AS total, CASE WHEN raw < 1000 THEN raw ELSE raw_final END AS final, 0::BIGINT AS corr, raw < 1000 AS ready,
    CASE WHEN raw < 1000 THEN raw ELSE raw_final END AS last, 0::BIGINT AS kept, provider FROM points WHERE n = 1
  UNION ALL
  SELECT p.c, p.seq, p.n, p.raw + k.corr, CASE WHEN p.raw + k.corr < 1000 THEN p.raw + k.corr ELSE p.raw_final + k.corr END, k.corr, p.raw + k.corr < 1000,
    CASE WHEN p.raw + k.corr < 1000 THEN p.raw + k.corr ELSE p.raw_final END, CASE WHEN p.raw + k.corr < 1000 THEN k.corr ELSE 0 END, p.provider
  FROM points p JOIN (SELECT c, n, CASE WHEN provider IS NULL THEN kept ELSE provider - last END AS corr FROM fold) k ON p.c = k.c AND p.n = k.n + 1)
SELECT c AS conv_id, seq, total, final, corr, ready FROM fold""",
    "anchor_replay_emergency": prefixed(["p2"], "RECURSIVE").replace(" OR is_ready OR failed", "") + """,
points AS (
  SELECT conv_id AS point, conv_id // 1000000 AS c, conv_id % 1000000 AS seq, row_number() OVER (PARTITION BY conv_id // 1000000 ORDER BY conv_id) AS n, any_value(total)::BIGINT AS raw,
    any_value(prepared)::BIGINT AS prepared, any_value(failed) AS failed, count(*) FILTER (is_masked) AS masked, any_value(trigger) AS trigger, any_value(emergency) AS emergency,
    any_value(max_tokens + tolerance) AS most, CASE WHEN (conv_id // 1000000) % 3 > 0 THEN 700 + (conv_id // 1000000) % 41 END AS provider
  FROM p7 GROUP BY conv_id),
runs AS (
  SELECT conv_id AS point, turn_group, sum(sum(cost)) OVER w AS upto, sum(sum(cost)) OVER w - sum(cost) AS earlier, sum(count(*)) OVER w AS n_dropped
  FROM p7 WHERE turn_group IS NOT NULL GROUP BY conv_id, turn_group WINDOW w AS (PARTITION BY conv_id ORDER BY turn_group ROWS UNBOUNDED PRECEDING)),
-- what an excess over the limit drops: the groups with less than that before them
steps AS (
  SELECT point, earlier::BIGINT AS lo, coalesce(lead(earlier) OVER (PARTITION BY point ORDER BY turn_group), 1000000000)::BIGINT AS hi, upto::BIGINT AS cost, n_dropped::BIGINT AS dropped FROM runs
  UNION ALL SELECT point, -1000000000, 0, 0, 0 FROM points
  UNION ALL SELECT point, 0, 1000000000, 0, 0 FROM points WHERE point NOT IN (SELECT point FROM runs)),
fold AS (
  SELECT c, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS total, 0::BIGINT AS final, 0::BIGINT AS corr, 0::BIGINT AS masked, 0::BIGINT AS dropped, '' AS outcome, 0::BIGINT AS last, 0::BIGINT AS next_corr
  FROM (SELECT DISTINCT c FROM points)
  UNION ALL
  SELECT c, n, seq, total, CASE WHEN failed OR ready THEN total ELSE raw_final + corr END, corr, CASE WHEN failed OR ready THEN 0 ELSE masked END, CASE WHEN failed OR ready THEN 0 ELSE dropped END,
    CASE WHEN failed THEN NULL WHEN ready THEN 'Ready' WHEN raw_final + corr <= most THEN CASE WHEN masked + dropped > 0 THEN 'Compacted' ELSE 'Ready' END
      WHEN masked + dropped > 0 THEN 'Degraded' ELSE 'ContextExhausted' END,
    CASE WHEN failed THEN last WHEN ready THEN total ELSE raw_final END,
    coalesce(provider - CASE WHEN failed THEN last WHEN ready THEN total ELSE raw_final END, CASE WHEN failed OR ready THEN corr ELSE 0 END)
  FROM (
    SELECT p.*, k.last, k.next_corr AS corr, p.raw + k.next_corr AS total, p.raw + k.next_corr < p.trigger AS ready, p.prepared - s.cost AS raw_final, s.dropped
    FROM fold k JOIN points p ON p.c = k.c AND p.n = k.n + 1 JOIN steps s ON s.point = p.point AND p.prepared + k.next_corr - p.emergency > s.lo AND p.prepared + k.next_corr - p.emergency <= s.hi))
SELECT c AS conv_id, seq, total, final, corr, masked::INTEGER AS masked, dropped::INTEGER AS dropped, outcome FROM fold WHERE n > 0""",
    "prefix_replay": prefixed(["p2"]) + "SELECT conv_id // 1000000 AS conv_id, conv_id % 1000000 AS point, outcome, tokens_before, tokens_after, masked, dropped FROM labelled",
    "audit_turn_table": TURNS + "SELECT session, turn, before, after, outcome, compacted, input FROM turns",
    "audit_savings": TURNS + """
SELECT session, count(*) AS turns, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, sum(input)::BIGINT AS input, sum(before - after)::BIGINT AS saved,
  sum(before - after) * 100.0::DOUBLE / sum(before) AS saved_percent, arg_max(before - after, turn) AS last_saved, arg_max((before - after) * 100.0::DOUBLE / before, turn) AS last_saved_percent
FROM turns GROUP BY session""",
    "audit_outcomes": TURNS + "SELECT outcome, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM turns GROUP BY outcome",
    "audit_invariants": AUDIT + "SELECT session, turn, invariant, observed, expected FROM found",
    "session_totals": TURNS + "SELECT session, turn, count(*) OVER w AS turns, sum(before) OVER w AS before, sum(after) OVER w AS after, sum(input) OVER w AS reported FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "grep_context": LINES + "SELECT path, line_no, line, previous, next FROM hits",
    "grep_capped_with_total": LINES + "SELECT n, path, line_no, matches, greatest(matches - 20, 0) AS more FROM hits WHERE n <= 20",
    "grep_blocks": LINES + """
SELECT path || ':' || line_no || ': ' || line || coalesce(chr(10) || '  ' || (line_no - 1) || '| ' || previous, '') || chr(10) || '> ' || line_no || '| ' || line
  || coalesce(chr(10) || '  ' || (line_no + 1) || '| ' || next, '') AS block FROM hits""",
    "read_range": LINES + "SELECT path, line_no, line FROM lines WHERE line_no BETWEEN 3 AND 6",
    "read_file_capped": LINES + "SELECT path, line_no, line FROM lines WHERE line_no <= 5",
    "last_lines": LINES + "SELECT path, line_no, line FROM lines QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 3",
    "token_bounded_truncate": """
WITH texts AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, chr(10) || '[Content truncated at 100 tokens. Use a smaller range or request a specific section.]' AS notice FROM documents)
SELECT doc_id, CASE WHEN ceil(length(t) / 4.0::DOUBLE) + 4 <= 100 THEN t ELSE regexp_replace(left(t, 384 - length(notice)), '\\s+$', '') || notice END AS text FROM texts""",
    "counted_truncate": r"""
WITH texts AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\S+')) <= 60 THEN t
  ELSE regexp_extract(t, '^(?:\S+\s+){45}\S+') || chr(10) || '[Content truncated at 60 tokens. Use a smaller range or request a specific section.]' END AS text FROM texts""",
    "char_truncate": "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 400) || chr(10) || '[... truncated: event content exceeded 400 chars ...]' END AS text FROM documents",
    "html_sniff": r"SELECT page_id, regexp_matches(html, '(?i)^\s*(<!doctype html|<html|<head|<body)') AS is_html FROM pages",
    "media_route": """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'json' WHEN 3 THEN 'text' WHEN 4 THEN 'binary' ELSE 'html' END AS route FROM pages""",
    "charset_from_meta": r"""SELECT page_id, nullif(regexp_extract(left(html, 8192), '(?i)<meta\s+[^>]*charset\s*=\s*["'']?\s*([A-Za-z0-9_-]+)', 1), '') AS charset FROM pages""",
    "collapse_whitespace": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents",
    "slugify": r"""
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'query') AS slug FROM documents""",
    "url_predicate": r"""
SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#\s]+') AS is_http, NULL::VARCHAR AS repository FROM pages WHERE page_id % 4 > 0
UNION ALL SELECT page_id, page_id % 8 = 0, 'Owner' || page_id || '/repo' FROM pages WHERE page_id % 4 = 0""",
    "path_normalize": r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/' || doc_id || '.txt' WHEN 1 THEN 'a/../b/' || doc_id WHEN 2 THEN '../up/' || doc_id ELSE '/abs/' || doc_id END AS path, doc_id % 4 >= 2 AS escapes FROM documents""",
    "runner_question": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Which branch ' || conv_id || '?' END AS question FROM conversations",
    "exchange_outcomes": EXCHANGES + """
SELECT session, exchange, CASE kind WHEN 'reply' THEN 'reply_received' WHEN 'max_turns' THEN 'max_turns_reached' ELSE kind END AS outcome, kind IN ('reply', 'max_turns') AS session_open,
  kind IN ('degraded', 'max_turns', 'cancelled') AS is_partial FROM exchanges""",
    "wrapup_trigger": EXCHANGES + """,
used AS (SELECT session, exchange, sum(greatest(turns, 0)) OVER (PARTITION BY session ORDER BY exchange ROWS UNBOUNDED PRECEDING) AS used FROM exchanges)
SELECT session, min(exchange) AS wrap_up_at, min(used)::BIGINT AS turns_used FROM used WHERE used >= 3 GROUP BY session""",
    "request_errors": """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'invalid_request' WHEN 2 THEN 'invalid_request' WHEN 3 THEN 'invalid_request' END AS error_code,
  CASE WHEN doc_id % 5 IN (2, 4) THEN 'r' || doc_id END AS request_id, CASE WHEN doc_id % 5 = 4 THEN 'submit' END AS command FROM documents""",
    "session_requests": """
WITH lines AS (
  SELECT *, 'host' || (conv_id % 4) AS channel, conv_id * 1000 + turn AS seq, turn * 60 + CASE WHEN conv_id % 5 = 4 AND turn > 3 THEN 7200 ELSE 0 END AS seconds,
    CASE WHEN turn = 0 THEN 'open_session' WHEN role = 'user' THEN 'submit' WHEN turn % 6 = 5 THEN 'close_session' WHEN conv_id % 3 = 0 THEN 'noop' ELSE 'ping' END AS command
  FROM conversations),
gaps AS (
  SELECT *, 'session_' || md5(channel || ':' || (conv_id * 1000)) AS session_id, seconds - lag(seconds) OVER (PARTITION BY conv_id ORDER BY turn) > 3600 AS late,
    command = 'close_session' OR command = 'submit' AND turn % 7 = 4 AS ends
  FROM lines WHERE command IN ('open_session', 'submit', 'close_session')),
held AS (
  SELECT *, NOT coalesce(bool_or(ends) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AND NOT coalesce(bool_or(late) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS held FROM gaps)
SELECT channel, seq, 'r' || conv_id || '-' || turn AS request_id, command, session_id,
  CASE WHEN NOT held AND turn > 0 THEN NULL WHEN turn = 0 THEN 'opened' WHEN command = 'close_session' THEN 'closed' WHEN turn % 7 = 4 THEN 'degraded' ELSE 'reply_received' END AS status,
  CASE WHEN held AND command = 'submit' THEN count(*) FILTER (held AND command = 'submit') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS exchange,
  CASE WHEN NOT held AND turn > 0 THEN 'session_not_found' END AS error_code, CASE WHEN NOT held AND turn > 0 THEN 'Session ' || chr(39) || session_id || chr(39) || ' is not open.' END AS error_message FROM held
UNION ALL SELECT channel, seq, 'r' || conv_id || '-' || turn, command, NULL, CASE command WHEN 'ping' THEN 'ok' END, NULL,
  CASE command WHEN 'noop' THEN 'unknown_command' END, CASE command WHEN 'noop' THEN 'Command ' || chr(39) || 'noop' || chr(39) || ' is not supported.' END FROM lines WHERE command IN ('ping', 'noop')""",
    "request_correlation": """
SELECT 'r' || doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN 'unanswered' WHEN doc_id % 3 = 1 THEN 'matched' ELSE 'unexpected' END AS status FROM documents""",
    "task_duplicate_ids": "SELECT upper(source) AS task, count(*) AS n FROM documents GROUP BY upper(source) HAVING count(*) > 1",
    "find_files": FILES + "SELECT path FROM files WHERE regexp_matches(path, '(?i)^src1/.*\\.md$') ORDER BY upper(path), path LIMIT 500",
    "list_directory": FILES + "SELECT split_part(path, '/', 1) AS name, true AS is_dir, NULL::BIGINT AS size FROM files GROUP BY 1",
    "file_tree": FILES + """
SELECT path, depth, is_dir FROM (
  SELECT DISTINCT split_part(path, '/', 1) AS path, 1 AS depth, true AS is_dir FROM files
  UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2, true FROM files)""",
    "tool_dispatch": r"""
WITH files AS (
  SELECT *, source || '/' || lang || '/Doc-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.MD' ELSE '.txt' END AS path FROM documents),
lines AS (
  SELECT doc_id, source, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files),
near AS (SELECT *, lag(line) OVER w AS previous, lead(line) OVER w AS next FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY upper(path), path, line_no) AS n, count(*) OVER (PARTITION BY source) AS total FROM near
  WHERE regexp_matches(line, 'password|token')),
found AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY upper(path), path) AS n, count(*) OVER (PARTITION BY source) AS total FROM files WHERE ends_with(lower(path), '.md')),
folders AS (SELECT DISTINCT source, lang FROM documents),
sources AS (SELECT DISTINCT source FROM documents)
SELECT 'd' || doc_id AS call_id, 'read_range' AS tool, line_no - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n, line AS text, 0 AS more, NULL AS error FROM lines
WHERE doc_id % 5 = 0 AND line_no BETWEEN 2 AND 4 OR doc_id % 5 = 4 AND line_no = 1
UNION ALL SELECT 'd' || doc_id, CASE doc_id % 5 WHEN 1 THEN 'read_file' WHEN 2 THEN 'rm' ELSE 'read_range' END, NULL, NULL, NULL,
  CASE doc_id % 5 WHEN 1 THEN 'file_not_found' WHEN 2 THEN 'unknown_tool' ELSE 'invalid_range' END FROM documents WHERE doc_id % 5 IN (1, 2, 3)
UNION ALL SELECT 'l' || source, 'list_directory', row_number() OVER (PARTITION BY source ORDER BY upper(lang), lang), lang || chr(9) || 'directory' || chr(9) || '0', 0, NULL FROM folders
UNION ALL SELECT 'f' || source, 'find_files', n, path, greatest(total - 500, 0), NULL FROM found WHERE n <= 500
UNION ALL SELECT 'g' || source, 'grep', n, path || ':' || line_no || ': ' || line || coalesce(chr(10) || '  ' || (line_no - 1) || '| ' || previous, '') || chr(10) || '> ' || line_no || '| ' || line
  || coalesce(chr(10) || '  ' || (line_no + 1) || '| ' || next, ''), greatest(total - 100, 0), NULL FROM hits WHERE n <= 100
UNION ALL SELECT 't' || source, 'file_tree', 1, source, 0, NULL FROM sources
UNION ALL SELECT 't' || source, 'file_tree', 1 + row_number() OVER (PARTITION BY source ORDER BY upper(lang), lang), '  ' || lang || '/', 0, NULL FROM folders
UNION ALL SELECT 'e' || source, 'list_directory', NULL, NULL, NULL, 'path_escape' FROM sources
UNION ALL SELECT 'x' || source, 'file_tree', NULL, NULL, NULL, 'directory_not_found' FROM sources""",
    "directory_size": FILES + "SELECT coalesce(sum(length), 0)::BIGINT AS bytes FROM files",
    "tool_result_bytes": "WITH " + MESSAGES + "SELECT conv_id, msg_idx, strlen(result) AS bytes FROM msgs WHERE role = 'Tool'",
    "budget_used": PREPARED + "SELECT conv_id, tokens_after * 100.0::DOUBLE / 2000 AS used FROM labelled",
    "pinned_append": "WITH " + MESSAGES + """
SELECT conv_id, msg_idx, role, 1 AS parts, tokens FROM msgs WHERE is_pinned
UNION ALL SELECT conv_id, count(*) AS msg_idx, 'User', 3, ceil((4 + length(conv_id::VARCHAR) + 4 + 6) / 4.0::DOUBLE)::BIGINT + 4 FROM msgs WHERE conv_id % 2 = 1 GROUP BY conv_id""",
    "custom_counter": "WITH " + MESSAGES + f"""
SELECT conv_id, msg_idx, CASE role WHEN 'Model' THEN {u16('text')} + 9 + length(args) WHEN 'Tool' THEN length(call_id) + {u16('result')} ELSE {u16('text')} END AS tokens FROM msgs""",
    "custom_strategy": PREPARED.replace("NOT is_pinned AND (rn <= wsize OR newer <= floor((max_tokens - pinned)::DOUBLE * fraction)) AS is_protected", "false AS is_protected")
    + "SELECT conv_id, outcome, error, tokens_before, tokens_after, masked, dropped FROM labelled",
    "segments_json": "WITH " + MESSAGES + """
SELECT conv_id, msg_idx, md5(CASE role
  WHEN 'Tool' THEN '[{"type":"ToolResultContent","toolCallId":"' || call_id || '","toolName":"web_fetch","content":' || to_json(
    CASE WHEN length(result) <= 200 THEN result ELSE left(result, 200) || chr(10) || '[... truncated: event content exceeded 200 chars ...]' END) || '}]'
  WHEN 'Model' THEN '[{"type":"TextContent","content":' || to_json(text) || '},{"type":"ToolUseContent","toolCallId":"' || call_id || '","toolName":"web_fetch","content":' || to_json(args) || '}]'
  ELSE '[{"type":"TextContent","content":' || to_json(text) || '}]' END) AS json FROM msgs""",
    "pretty_json": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{' || chr(10) || '  "page_id": ' || page_id || chr(10) || '}' WHEN 1 THEN '{}' ELSE 'no json ' || page_id END AS json FROM pages""",
    "response_lines": EXCHANGES + """
SELECT '{"session":' || session || ',"exchange":' || exchange || ',"outcome":"' || CASE kind WHEN 'reply' THEN 'reply_received' WHEN 'max_turns' THEN 'max_turns_reached' ELSE kind END
  || '","session_open":' || (kind IN ('reply', 'max_turns')) || '}' AS value FROM exchanges""",
    "response_segments": """
WITH replies AS (SELECT * FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 0 AS seg, 'text' AS kind, NULL::VARCHAR AS tool_call_id, NULL::VARCHAR AS tool_name, md5(text) AS content FROM replies WHERE trim(text) <> ''
UNION ALL SELECT conv_id, turn, (trim(text) <> '')::INT, 'tool_use', 'c' || turn, 'tool', md5(CASE WHEN turn % 2 = 0 THEN '{}' ELSE '{"a":1}' END) FROM replies""",
    "reported_input_tokens": "SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN turn * 10 END AS tokens FROM conversations",
    "session_summary": TURNS + """
SELECT session, count(*) AS turns, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, sum(input)::BIGINT AS input, sum(before - after)::BIGINT AS saved, 'model-a' AS model,
  2000 AS window_tokens, max(turn) * 60.0::DOUBLE AS seconds FROM turns GROUP BY session""",
    "transcript_header": TURNS + "SELECT DISTINCT session, 'model-a' AS model, 2000 AS window_tokens, 0.5::DOUBLE AS soft_ratio, 0.8::DOUBLE AS hard_ratio FROM turns",
    "status_lines": TURNS + """
SELECT session, turn * 2 + 1 AS seq, format('{:,} / 2,000 ({:.1f}%)', after, after * 100.0::DOUBLE / 2000) AS line FROM turns""",
    "renderer_notices": """
SELECT conv_id AS session, turn AS seq, CASE WHEN role = 'system' AND conv_id % 2 <> 0 THEN 'Session Ended' END AS title, CASE
  WHEN role = 'system' AND conv_id % 2 = 0 THEN 'Session ended. Transcript saved to log-' || conv_id || '.md'
  WHEN role = 'system' THEN 'ContextExhausted. Total turns: ' || turn || '. Total tokens: n/a.' || chr(10) || 'See session log: log-' || conv_id || '.md'
  WHEN turn % 3 = 0 THEN NULL WHEN turn % 2 = 1 OR trim(text) = '' THEN 'Model issuing ' || (turn % 3) || ' tool call(s).'
  ELSE 'Model responded and requested ' || (turn % 3) || ' tool call(s).' END AS notice,
  CASE WHEN role <> 'system' AND turn % 3 > 0 AND turn % 2 = 0 AND trim(text) <> '' THEN md5(text) END AS shown FROM conversations""",
    "next_messages": """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'answer: q' || turn WHEN turn % 2 = 0 AND conv_id % 2 <> 0 THEN 'wrap_up' ELSE 'continue' END AS message FROM conversations""",
    "turn_budget_violations": """
SELECT conv_id, turn, concat_ws(',', CASE WHEN turn - 1 <= 0 THEN 'max_turns_not_positive' END, CASE WHEN conv_id % 4 - 1 < 0 THEN 'wrap_window_negative' END,
  CASE WHEN conv_id % 4 - 1 >= turn - 1 THEN 'wrap_window_too_long' END) AS rules FROM conversations""",
    "redacted_options": """
SELECT event_id, path, value FROM (
  SELECT event_id, unnest(['Model.Name', 'Model.ApiKey', 'Model.Temperature', 'Tools[0].Name', 'Tools[0].Secret', 'Tools[1].Name', 'Tools[1].Token', 'Props.' || json_keys(props)[1]]) AS path,
    unnest(['m' || event_id, '***', '0.5', 'a', '***', event_type, NULL, json_extract_string(props, '$.' || json_keys(props)[1])]) AS value FROM events)""",
    "log_names": SESSIONS + "SELECT log_name FROM named",
    "log_page": SESSIONS + "SELECT log_name FROM named ORDER BY upper(log_name) DESC, log_name DESC LIMIT 10 OFFSET 10",
    "find_workspace": "SELECT DISTINCT source AS name, 'Owner/' || source AS owner_repo FROM documents WHERE upper(source) = 'SRC1'",
    "search_results": """
SELECT page_id, 1 AS rank, 'T ' || page_id AS title, url, 'a b' AS snippet FROM pages UNION ALL SELECT page_id, 2, 'second', url, NULL FROM pages""",
    "binary_files": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE strlen(html) < 4096 END AS is_binary FROM pages",
    "guarded_paths": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/' || doc_id ELSE 'a/../b/' || doc_id END AS path FROM documents WHERE doc_id % 4 < 2",
    "token_limits": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 4000 WHEN 3 THEN 700 WHEN 4 THEN 12000 WHEN 5 THEN 12000 END::BIGINT AS most FROM documents",
    "decoded_bodies": """
SELECT page_id, md5(CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN html WHEN 2 THEN translate(html, 'éè', 'ee') ELSE 'café' END) AS text FROM pages""",
    "ranked_violations": AUDIT + """
SELECT session, turn, invariant, observed, expected, row_number() OVER (PARTITION BY session ORDER BY severity, turn, invariant) AS rank FROM found""",
    "html_strip_text": r"""
WITH kept AS (SELECT page_id, replace(regexp_replace(html, '<script>var t="</p>"', '<script>var t="' || chr(1) || '"', 'g'), chr(1), chr(2)) AS body FROM pages),
bare AS (SELECT page_id, regexp_replace(regexp_replace(body, '<!--[\s\S]*?-->', '', 'g'), '<[^>]*>', '', 'g') AS t FROM kept),
named AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM bare)
SELECT page_id, trim(regexp_replace(replace(t, chr(2), '</p>'), '\s+', ' ', 'g')) AS text FROM named""",
}
