"""Tool calls answered in a batch: a table of calls is routed by name and joined with a table of files.

Calls of one kind are answered together. Reads are an equality join on the path and a slice of the
file's lines; listings, trees and globs are joins on the folders above a file; all patterns of grep are
searched in one pass over the texts, by automata whose time is linear in a line whatever the pattern. What cannot be answered is a
row with an error, so no call is lost. Every answer is capped as that of the single operators, and rows beyond a
cap are counted, not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.text import is_blank, normalize_newlines
from windrow.sources.files import glob_regex, grep_block, pieces

# Fixed values of the tools' contract: names, caps and messages.
READS, FOLDERS = ("read_file", "read_range"), ("list_directory", "find_files", "file_tree")
OUTSIDE = ("web_search", "web_fetch", "create_file", "write_text")
LINE_CAP, ENTRY_CAP, NODE_CAP, MATCH_CAP = 2000, 500, 1000, 100
MESSAGES = {
    "unknown_tool": "unknown tool", "outside_effect": "tool acts outside the file table", "invalid_arguments": "arguments must be a JSON object", "path_escape": "path escapes the workspace",
    "invalid_range": "invalid range: startLine must be >= 1 and endLine must be >= startLine", "pattern_required": "pattern is required", "invalid_regex": "invalid regex",
    "invalid_max_matches": "maxMatches must be greater than 0", "glob_required": "glob is required", "invalid_max_depth": "maxDepth must be greater than or equal to 0",
    "file_not_found": "file not found", "directory_not_found": "directory not found", "binary_file": "binary file, cannot display as text",
}
ANSWER = ("call_id", "tool", "n", "text", "more", "error")
HITS = "spec int, hits long, upper string, path string, line_no int, line string, previous string, following string"


def parse_calls(calls: DataFrame) -> DataFrame:
    """call_id, tool, the arguments by column, key (the path without `.` and empty segments) and the error that shows before any file is read.

    Argument names are read without regard to case; where one is repeated the last counts. A path may not be absolute or have a segment `..`.
    """
    given = F.from_json("arguments", "map<string,string>")
    named = lambda name: F.try_element_at(F.filter(F.map_entries("_a"), lambda e: F.lower(e["key"]) == name.lower()), F.lit(-1))["value"]
    number = lambda name: named(name).try_cast("int")
    rows = calls.select("call_id", "tool", given.alias("_a")).withColumns({
        "path": F.when(is_blank(named("path")), ".").otherwise(F.replace(named("path"), F.lit("\\"), F.lit("/"))),
        "pattern": named("pattern"), "glob": F.when(F.col("tool") == "grep", named("pathGlob")).otherwise(named("glob")),
        "start": number("startLine"), "end": number("endLine"), "max_depth": number("maxDepth"), "max_matches": number("maxMatches"),
    })
    rows = rows.withColumn("glob", F.when(~is_blank(F.col("glob")), F.replace("glob", F.lit("\\"), F.lit("/"))))
    segments = F.transform(F.split("path", "/"), lambda s: F.trim(s))
    tool = F.col("tool")
    escapes = F.col("path").rlike(r"^(/|[A-Za-z]:)") | F.array_contains(segments, "..")
    error = (
        F.when(is_blank(tool) | ~tool.isin(*READS, *FOLDERS, *OUTSIDE, "grep"), "unknown_tool").when(tool.isin(*OUTSIDE), "outside_effect").when(F.col("_a").isNull(), "invalid_arguments")
        .when((tool == "read_range") & F.coalesce((F.col("start") < 1) | (F.col("end") < F.col("start")), F.lit(True)), "invalid_range")
        .when((tool == "find_files") & F.col("glob").isNull(), "glob_required").when((tool == "file_tree") & (F.col("max_depth") < 0), "invalid_max_depth")
        .when((tool == "grep") & is_blank(F.col("pattern")), "pattern_required").when((tool == "grep") & (F.col("max_matches") <= 0), "invalid_max_matches")
        .when(tool.isin(*READS, *FOLDERS) & escapes, "path_escape")
    )
    key = F.array_join(F.filter(segments, lambda s: (s != "") & (s != ".")), "/")
    return rows.select("call_id", "tool", key.alias("key"), "pattern", "glob", "start", "end", "max_depth", "max_matches", error.alias("error"))


def _answer(rows: DataFrame, n: Column | str, text: Column | str, more: Column | str) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("call_id", "tool", as_col(n).cast("int").alias("n"), as_col(text).alias("text"), as_col(more).cast("long").alias("more"), F.lit(None).cast("string").alias("error"))


def _failed(rows: DataFrame, error: Column) -> DataFrame:
    none = F.lit(None)
    return rows.withColumn("error", error).filter("error IS NOT NULL").select("call_id", "tool", none.cast("int").alias("n"), none.cast("string").alias("text"), none.cast("long").alias("more"), "error")


def answer_reads(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the files asked for: all, or a range that includes both ends; LINE_CAP at most."""
    asked = calls.select("call_id", "tool", "key", F.when(F.col("tool") == "read_file", 1).otherwise(F.col("start")).alias("start"), F.when(F.col("tool") == "read_range", F.col("end")).alias("end"))
    found = asked.join(files.select("path", "text"), F.col("key") == F.col("path"), "left")
    failed = _failed(found, F.when(F.col("path").isNull(), "file_not_found").when(F.col("text").isNull(), "binary_file"))
    lines = found.filter("text IS NOT NULL").withColumn("lines", pieces(F.col("text")))
    lines = lines.withColumn("many", F.greatest(F.least(F.coalesce("end", F.size("lines")), F.size("lines")) - F.col("start") + 1, F.lit(0)))
    shown = lines.select("call_id", "tool", "many", F.posexplode(F.slice("lines", F.col("start"), F.least("many", F.lit(LINE_CAP)))).alias("n", "line"))
    return _answer(shown, F.col("n") + 1, "line", F.greatest(F.col("many") - LINE_CAP, F.lit(0))).unionByName(failed)


def _capped(rows: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The first `cap` rows of each call with their number n and how many more there are. Only those rows meet in one task."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("call_id").orderBy(*order))).filter(F.col("n") <= cap)
    return first.join(rows.groupBy("call_id").agg(F.count("*").alias("all")), "call_id").withColumn("more", F.greatest(F.col("all") - cap, F.lit(0)))


def _glob_column(glob: Column) -> Column:
    """files.glob_regex as a column: `*` within a name, `**` across folders."""
    out = F.regexp_replace(F.regexp_replace(glob, r"^\./", ""), r"([\\.^$+?()\[\]{}|])", r"\\$1")
    for mark, token in (("**/", "\x01"), ("**", "\x02"), ("*", "\x03")):
        out = F.replace(out, F.lit(mark), F.lit(token))
    for token, meant in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*")):
        out = F.replace(out, F.lit(token), F.lit(meant))
    return F.concat(F.lit("(?is)^"), out, F.lit("$"))


def answer_folders(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Entries, trees and found paths of the folders asked for. A folder is there if a file lies below it; the root always is."""
    asked = calls.select("call_id", "tool", "key", "glob", "max_depth")
    parts = F.split("path", "/")
    above = files.select("path", "length", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k"))
    above = above.select("path", "length", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("folder"), F.expr("slice(parts, k + 1, size(parts))").alias("rest"))
    missing = asked.filter("key <> ''").join(above.select("folder"), F.col("key") == F.col("folder"), "left_anti")
    below = asked.join(above, F.col("key") == F.col("folder"))

    entries = below.filter("tool = 'list_directory'").groupBy("call_id", "tool", F.col("rest")[0].alias("name"), (F.size("rest") > 1).alias("is_dir")).agg(F.sum("length").alias("size"))
    entry = F.concat_ws("\t", "name", F.when(F.col("is_dir"), "directory").otherwise("file"), F.when(F.col("is_dir"), 0).otherwise(F.col("size")).cast("string"))
    listed = _answer(_capped(entries, ENTRY_CAP, F.col("is_dir").desc(), F.upper("name"), F.col("name")), "n", entry, "more")

    matching = below.filter("tool = 'find_files'").filter(F.rlike(F.array_join("rest", "/"), _glob_column(F.col("glob")))).select("call_id", "tool", "path")
    found = _answer(_capped(matching, ENTRY_CAP, F.upper("path"), F.col("path")), "n", "path", "more")

    tree = below.filter("tool = 'file_tree'").withColumn("deep", F.size("rest"))
    tree = tree.select("call_id", "tool", "rest", "deep", F.explode(F.expr("slice(sequence(1, deep), 1, least(deep, coalesce(max_depth, deep)))")).alias("depth"))
    node = tree.select("call_id", "tool", F.slice("rest", 1, F.col("depth")).alias("node"), "depth", (F.col("depth") < F.col("deep")).alias("is_dir")).distinct()
    step = F.transform("node", lambda p, i: F.concat(F.when((i + 1 < F.size("node")) | F.col("is_dir"), "0").otherwise("1"), F.upper(p), F.lit("\x00"), p))
    name = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.element_at("node", -1), F.when(F.col("is_dir"), "/").otherwise(""))
    # the folder itself is the first node
    roots = asked.filter("tool = 'file_tree'").join(missing.select("call_id"), "call_id", "left_anti")
    roots = roots.select("call_id", "tool", F.when(F.col("key") == "", ".").otherwise(F.col("key")).alias("name"), F.array().cast("array<string>").alias("step"))
    nodes = node.select("call_id", "tool", name.alias("name"), step.alias("step")).unionByName(roots)
    trees = _answer(_capped(nodes, NODE_CAP, F.col("step")), "n", "name", "more")
    return listed.unionByName(found).unionByName(trees).unionByName(_failed(missing, F.lit("directory_not_found")))


def linear_regex(pattern: str) -> bool:
    """Whether a pattern can be searched in time linear in the text: no look-around and no references back, and well formed."""
    try:
        pc.match_substring_regex(pa.array([""]), f"(?m){pattern}")
    except pa.ArrowInvalid:
        return False
    return True


def grep_many(files: DataFrame, specs: list[tuple[int, str, str | None]], cap: int = MATCH_CAP) -> DataFrame:
    """HITS of many patterns (number, pattern, glob of paths or None) in one pass over files (path, text).

    A batch gives for each pattern its first `cap` lines in order of path and line, and in a row without path
    how many lines matched. Lines have their neighbours with them, so nothing is exchanged. Patterns are those of `linear_regex`.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(batch.column("text"), "\n")
            if not len(batch):
                continue
            flat, owner = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
            first = np.zeros(len(batch), dtype=np.int64)
            first[owner[::-1]] = np.arange(len(owner))[::-1]
            number = np.arange(len(owner)) - first[owner] + 1
            last = np.append(owner[1:] != owner[:-1], True)
            real = ~(last & np.asarray(pc.equal(flat, "")))  # the empty piece after a final line feed is no line
            for spec, pattern, glob in specs:
                wanted = np.asarray(pc.match_substring_regex(flat, f"(?m){pattern}")) & real
                if glob is not None:
                    wanted &= np.asarray(pc.match_substring_regex(batch.column("path"), glob_regex(glob)))[owner]
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                keys = pa.table({"upper": batch.column("upper").take(pa.array(owner[at])), "path": batch.column("path").take(pa.array(owner[at])), "line_no": pa.array(number[at].astype(np.int32))})
                order = np.asarray(pc.select_k_unstable(keys, min(cap, len(at)), [("upper", "ascending"), ("path", "ascending"), ("line_no", "ascending")]))
                at, keys = at[order], keys.take(pa.array(order)).combine_chunks()
                before, after = number[at] > 1, ~last[at] & real[np.minimum(at + 1, len(owner) - 1)]
                n = len(at)
                out = {
                    "spec": [spec] * n, "hits": [None] * n, "upper": keys.column("upper"), "path": keys.column("path"), "line_no": keys.column("line_no"), "line": flat.take(pa.array(at)),
                    "previous": flat.take(pa.array(at - 1, mask=~before)), "following": flat.take(pa.array(at + 1, mask=~after)),
                }
                kinds = {"spec": pa.int32(), "hits": pa.int64(), "line_no": pa.int32()}
                fit = {k: (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v, kinds[k])).cast(kinds.get(k, pa.string())) for k, v in out.items()}
                yield pa.record_batch(fit)
                total = int(wanted.sum())
                yield pa.record_batch({k: pa.array([{"spec": spec, "hits": total}.get(k)], kinds.get(k, pa.string())) for k in out})

    texts = files.filter("text IS NOT NULL").select("path", F.upper("path").alias("upper"), normalize_newlines(F.col("text")).alias("text"))
    return texts.mapInArrow(scan, HITS)


def answer_greps(calls: DataFrame, files: DataFrame, at_once: int = 256) -> DataFrame:
    """Matching lines with their neighbours. Different patterns are searched `at_once` in a pass; equal ones once."""
    asked = calls.select("call_id", "tool", "pattern", "glob", F.least(F.coalesce("max_matches", F.lit(MATCH_CAP)), F.lit(MATCH_CAP)).alias("cap"))
    spark = calls.sparkSession
    each = enumerate(asked.select("pattern", "glob").distinct().orderBy("pattern", "glob").toLocalIterator())
    answers = None
    while block := list(islice(each, at_once)):
        specs = [(i, r["pattern"], r["glob"]) for i, r in block]
        good = [s for s in specs if linear_regex(s[1])]
        known = spark.createDataFrame([(*s, s in good) for s in specs], "spec int, pattern string, glob string, good boolean")  # `at_once` rows
        mine = asked.join(F.broadcast(known), asked["pattern"].eqNullSafe(known["pattern"]) & asked["glob"].eqNullSafe(known["glob"])).select("call_id", "tool", "cap", "spec", "good")
        part = _failed(mine, F.when(~F.col("good"), "invalid_regex"))
        if good:
            hits = grep_many(files, good)
            ranked = hits.filter("path IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("spec").orderBy("upper", "path", "line_no"))).filter(F.col("n") <= MATCH_CAP)
            totals = hits.filter("path IS NULL").groupBy("spec").agg(F.sum("hits").alias("all"))
            shown = mine.join(ranked.join(totals, "spec"), "spec").filter("n <= cap")
            block_text = grep_block(*(F.col(c) for c in ("path", "line_no", "line", "previous", "following")))
            part = part.unionByName(_answer(shown, "n", block_text, F.greatest(F.col("all") - F.col("cap"), F.lit(0))))
        answers = part if answers is None else answers.unionByName(part)
    return _failed(asked.limit(0), F.lit("invalid_regex")) if answers is None else answers


def dispatch(calls: DataFrame, files: DataFrame) -> DataFrame:
    """call_id, tool, n, text, more and error: the rows of each call's answer in order, how many more there are, or an error of MESSAGES.

    calls: call_id (one row each), tool and arguments (a JSON object); files: path (relative, with `/`), length and text
    (null for a binary file). A call whose answer is empty has no rows. Tools that act outside the file table are errors.
    """
    parsed = parse_calls(calls)
    good = parsed.filter("error IS NULL")
    answers = [answer_reads(good.filter(F.col("tool").isin(*READS)), files), answer_folders(good.filter(F.col("tool").isin(*FOLDERS)), files), answer_greps(good.filter("tool = 'grep'"), files)]
    out = _failed(parsed, F.col("error"))
    for part in answers:
        out = out.unionByName(part)
    return out.select(*ANSWER)


def tool_results(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """call_id, tool and result, the text that a tool returns; empty for an empty answer. Answers are capped, so a call's rows fit in one."""
    head = F.when(F.col("tool") == "list_directory", "name\ttype\tsizeBytes\n").otherwise("")
    unit = F.when(F.col("tool").isin(*READS), "lines").when(F.col("tool") == "grep", "matches").when(F.col("tool") == "file_tree", "nodes").otherwise("entries")
    body = F.when(F.col("tool") == "grep", F.array_join("rows.text", "\n\n")).otherwise(F.array_join("rows.text", "\n"))
    said = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    whole = answers.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("rows"), F.max("more").alias("more"), F.max("error").alias("error"))
    marker = F.concat(F.lit("\n[... truncated: "), F.col("more"), F.lit(" more "), unit, F.lit("; cap "), F.size("rows"), F.lit(" "), unit, F.lit(" hit ...]"))
    text = F.concat(head, body, F.when(F.col("more") > 0, marker).otherwise(""))
    joined = calls.select("call_id", "tool").join(whole, "call_id", "left")
    result = F.when(F.col("rows").isNull(), F.when(F.col("tool") == "list_directory", "name\ttype\tsizeBytes").otherwise("")).when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), said[F.col("error")])).otherwise(text)
    return joined.select("call_id", "tool", result.alias("result"))
