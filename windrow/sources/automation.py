"""Automation logs: requests, responses, task manifests and the policies of the runner."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions.text import collapse_whitespace, is_blank, runner_question, slugify

REQUEST = "requestId string, command string, payload string, _corrupt_record string"
REDACTED = "***"


def parse_requests(lines: DataFrame, column: str = "line") -> DataFrame:
    """The line with request_id, command, payload, error_code and error_message."""
    parsed = F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("r", parsed)
    is_null = F.trim(column) == "null"
    code = (
        F.when(is_null, "invalid_request").when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull() | ~F.col(column).rlike(r"(?s)^\s*\{.*\}\s*$"), "malformed_json")
        .when(is_blank(F.col("r.requestId")) | is_blank(F.col("r.command")), "invalid_request")
    )
    message = (
        F.when(is_null, "Request body must deserialize to JSON object.").when(code == "malformed_json", "Request line is not valid JSON.")
        .when(is_blank(F.col("r.requestId")), "Request field 'requestId' is required.").when(is_blank(F.col("r.command")), "Request field 'command' is required.")
    )
    keep = (code != "malformed_json") & ~is_blank(F.col("r.requestId"))
    return rows.select(
        *lines.columns, F.when(code.isNull() | keep, F.col("r.requestId")).alias("request_id"), F.when(code.isNull(), F.col("r.command")).alias("command"),
        F.when(code.isNull(), F.col("r.payload")).alias("payload"), code.alias("error_code"), message.alias("error_message"),
    )


def correlate(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id and whether it is `matched`, `unanswered` or `unexpected`."""
    both = requests.select("request_id", F.lit(1).alias("asked")).join(responses.select("request_id", F.lit(1).alias("answered")), "request_id", "full")
    return both.select("request_id", F.when(F.col("asked").isNull(), "unexpected").when(F.col("answered").isNull(), "unanswered").otherwise("matched").alias("status"))


def exchange_results(exchanges: DataFrame) -> DataFrame:
    """exchange rows (kind, text, turns, tokens, reason, ...) with outcome, session_open, assistant text and runner question."""
    outcome = F.create_map(*[F.lit(x) for pair in (("reply", "reply_received"), ("degraded", "degraded"), ("max_turns", "max_turns_reached"), ("cancelled", "cancelled"), ("failed", "failed")) for x in pair])
    text = F.when(F.col("kind") != "failed", F.col("text"))
    question = runner_question(text)
    return exchanges.withColumns({
        "outcome": outcome[F.col("kind")], "session_open": F.col("kind").isin("reply", "max_turns"), "assistant_text": text,
        "is_partial": F.col("kind").isin("degraded", "max_turns", "cancelled") & ~is_blank(text), "asks_runner": question.isNotNull(), "runner_question": question,
        "degradation_reason": F.when(F.col("kind") == "degraded", F.col("reason")), "reported_tokens": F.when(F.col("kind") == "reply", F.col("tokens")),
    })


def responses_json(rows: DataFrame) -> DataFrame:
    """One JSON line for each row, as `value`."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("taskId string, title string, repositoryUrl string, taskSize string, initialPrompt string").json(path, multiLine=True)


def task_violations(tasks: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """taskId and rule for each rule that a task breaks. Ids are compared without regard to case."""
    required = [(c, F.when(is_blank(F.col(c)), F.lit(f"{c}_required"))) for c in ("taskId", "title", "repositoryUrl", "taskSize", "initialPrompt")]
    same = Window.partitionBy(F.upper("taskId"))
    duplicate = F.when(~is_blank(F.col("taskId")) & (F.col("same") > 1), F.lit("taskId_duplicate"))
    url = F.col("repositoryUrl")
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    bad_url = F.when(~is_blank(url) & ~F.when(absolute, url.rlike(r"(?i)^https://github\.com(?::\d+)?(?:[/?#]|$)")).otherwise(url.rlike("(?i)^git@github\\.com:")), F.lit("repositoryUrl_not_github"))
    missing = [F.when(~is_blank(F.col("initialPrompt")) & ~F.contains("initialPrompt", F.lit(p)), F.lit(f"phrase_missing:{p}")) for p in phrases]
    rules = F.array_compact(F.array(*(r for _, r in required), duplicate, bad_url, *missing))
    return tasks.withColumn("same", F.count("*").over(same)).select("taskId", F.explode(rules).alias("rule"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values, without regard to case, that occur more than once, and how often."""
    return rows.groupBy(F.upper(column).alias(column)).agg(F.count("*").alias("n")).filter("n > 1")


def wrap_up(exchanges: DataFrame, max_turns: int, wrap_window: int) -> DataFrame:
    """session and the first exchange at which the turns used reach max_turns - wrap_window."""
    so_far = Window.partitionBy("session").orderBy("exchange").rowsBetween(Window.unboundedPreceding, 0)
    used = exchanges.withColumn("used", F.sum(F.greatest(F.col("turns"), F.lit(0))).over(so_far))
    return used.filter(F.col("used") >= max_turns - wrap_window).groupBy("session").agg(F.min("exchange").alias("wrap_up_at"), F.min("used").alias("turns_used"))


def budget_profile_violations(max_turns: Column, wrap_window: Column) -> Column:
    return F.array_compact(F.array(
        F.when(max_turns <= 0, F.lit("max_turns_not_positive")), F.when(wrap_window < 0, F.lit("wrap_window_negative")), F.when(wrap_window >= max_turns, F.lit("wrap_window_too_long"))))


def next_message(asks: Column, question: Column, wrap_due: Column, wrap_sent: Column) -> Column:
    """What the runner says next: an answer to a question, once the wrap-up, else to go on."""
    return F.when(asks, F.concat(F.lit("answer: "), question)).when(wrap_due & ~wrap_sent, "wrap_up").otherwise("continue")


def search_results(payloads: DataFrame, column: str = "body", k: int = 5) -> DataFrame:
    """rank, title, url and snippet of the first k results that have a title and a url."""
    body = F.from_json(column, "web struct<results:array<struct<title:string,url:string,description:string>>>")
    usable = F.filter(F.coalesce(body["web"]["results"], F.array().cast("array<struct<title:string,url:string,description:string>>")), lambda r: ~is_blank(r["title"]) & ~is_blank(r["url"]))
    one = payloads.select(*[c for c in payloads.columns if c != column], F.posexplode(F.slice(usable, 1, max(1, min(k, 10)))).alias("rank", "r"))
    kept = [c for c in one.columns if c not in ("rank", "r")]
    return one.select(*kept, (F.col("rank") + 1).alias("rank"), collapse_whitespace(F.col("r.title")).alias("title"), F.col("r.url").alias("url"), collapse_whitespace(F.col("r.description")).alias("snippet"))


def flatten_options(options: Mapping, secrets: str = r"(?i)(key|token|secret|password)$") -> list[tuple[str, str | None]]:
    """Nested options as dotted path and value, secrets replaced."""
    rows: list[tuple[str, str | None]] = []

    def walk(prefix: str, value) -> None:
        if isinstance(value, Mapping):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else str(k), v)
        elif isinstance(value, (list, tuple)):
            for i, v in enumerate(value):
                walk(f"{prefix}[{i}]", v)
        else:
            hide = value is not None and re.search(secrets, prefix.rsplit(".", 1)[-1]) and not isinstance(value, (int, float))
            rows.append((prefix, REDACTED if hide else None if value is None else str(value)))

    walk("", options)
    return rows


def flatten_json(rows: DataFrame, column: str, secrets: str = r"(?i)(key|token|secret|password)$", depth: int = 6) -> DataFrame:
    """The other columns with path and value of each leaf of a column of nested options in JSON, texts under secret names replaced.

    A level at a time is taken apart as variants, in one job; empty objects and arrays, and what lies deeper than `depth` levels, are
    leaves with their JSON. Rows whose JSON is null or malformed have none. The rules are those of flatten_options.
    """
    kept = [c for c in rows.columns if c != column]
    tvf = rows.sparkSession.tvf
    level = rows.select(*kept, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).filter("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    nested = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>"))
    leaves = None
    for _ in range(depth):
        here = level.filter(~nested)
        leaves = here if leaves is None else leaves.unionByName(here)
        parts = level.filter(nested).lateralJoin(tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "item"))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))
        level = parts.select(*kept, F.concat("path", step).alias("path"), F.col("item").alias("v"))
    leaves = leaves.unionByName(level)
    hide = (kind == "STRING") & F.regexp_extract("path", r"([^.]*)$", 1).rlike(secrets)
    return leaves.select(*kept, "path", F.when(hide, REDACTED).otherwise(F.try_variant_get("v", "$", "string")).alias("value"))


#: Options by path, with what each has to be.
OPTION_RULES = {
    "Budget.ContextWindowTokens": "non_negative", "Budget.SoftThresholdRatio": "ratio", "Budget.HardThresholdRatio": "ratio", "Budget.WindowSize": "non_negative", "Model.Name": "text",
    "Model.MaxOutputTokens": "non_negative", "Workspace.RootDirectory": "text", "Workspace.CloneDepth": "non_negative", "Workspace.MaxRepoSizeMB": "non_negative",
    "Logging.SessionLogsDirectory": "text", "Agent.MaxTurns": "positive", "OpenRouter": "section",
}


def option_violations(options: Mapping) -> list[tuple[str, str]]:
    """(path, rule) for each rule that the options break; a section that is missing is reported once."""
    fits = {
        "non_negative": lambda v: isinstance(v, int) and v >= 0, "positive": lambda v: isinstance(v, int) and v > 0, "ratio": lambda v: isinstance(v, (int, float)) and 0 < v <= 1,
        "text": lambda v: isinstance(v, str) and bool(v.strip()), "section": lambda v: v is not None,
    }
    found: list[tuple[str, str]] = []
    for path, rule in OPTION_RULES.items():
        section, _, name = path.partition(".")
        if options.get(section) is None:
            if (section, "section") not in found:
                found.append((section, "section"))
        elif name and not fits[rule](options[section].get(name)):
            found.append((path, rule))
    broken = {path for path, _ in found} | {section for section, _ in found}
    ratios = "Budget.SoftThresholdRatio", "Budget.HardThresholdRatio"
    if not broken & {"Budget", *ratios} and options["Budget"]["HardThresholdRatio"] <= options["Budget"]["SoftThresholdRatio"]:
        found.append((ratios[1], "over_soft_ratio"))
    return found


def newest_workspaces(workspaces: DataFrame) -> DataFrame:
    return workspaces.orderBy(F.desc("cloned_at"), "name")


def find_workspace(workspaces: DataFrame, owner_repo: str) -> DataFrame:
    return newest_workspaces(workspaces.filter(F.upper("owner_repo") == owner_repo.upper())).limit(1)


def log_names(sessions: DataFrame) -> DataFrame:
    """sessions (started, workspace, query) with log_name; equal names are told apart by a number."""
    stem = F.concat_ws("-", F.date_format("started", "yyyyMMdd"), F.date_format("started", "HHmmssSSS"), slugify(F.col("workspace")), slugify(F.col("query")))
    named = sessions.withColumn("stem", stem)
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("started", "workspace", "query"))
    return named.withColumn("log_name", F.concat("stem", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(""), F.lit(".md"))).drop("stem")


def log_page(logs: DataFrame, page: int, size: int) -> DataFrame:
    """One page of logs by name, newest first."""
    return logs.orderBy(F.upper("log_name").desc(), F.desc("log_name")).offset(page * size).limit(size)
