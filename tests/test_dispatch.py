"""Dispatched tool calls against the single operators and against plain Python."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from windrow.sources import dispatch, files


@pytest.fixture(scope="module")
def tree(spark):
    r = random.Random(7)
    rows = []
    for i in range(300):
        folder = r.choice(["src", "src/deep", "Src20", "docs/a/b", ""])
        text = "\n".join(r.choice(["alpha", "beta token", "", "gamma", "password x"]) for _ in range(r.randint(0, 12))) + r.choice(["", "\n", "\r\n"])
        rows.append((f"{folder}/f{i}.{r.choice(['md', 'TXT'])}".lstrip("/"), len(text), text))
    rows += [("big.log", 1, "line\n" * 2500), ("bin/x.dat", 9, None), ("src/empty.txt", 0, "")]
    return spark.createDataFrame(rows, "path string, length long, text string").repartition(3).cache()


def answers(spark, tree, calls):
    rows = [(str(i), tool, args if isinstance(args, (str, type(None))) else json.dumps(args)) for i, (tool, args) in enumerate(calls)]
    frame = spark.createDataFrame(rows, "call_id string, tool string, arguments string")
    got = dispatch.dispatch(frame, tree)
    out = {i: [] for i in range(len(calls))}
    for r in got.collect():
        out[int(r.call_id)].append((r.n, r.text, r.more, r.error))
    return [sorted(out[i], key=lambda x: x[0] or 0) for i in range(len(calls))], frame, got


def test_mixed_calls_equal_the_single_operators(spark, tree):
    calls = [
        ("read_range", {"path": "src/deep/../x", "startLine": 1, "endLine": 2}), ("read_file", {"PATH": "big.log"}), ("read_range", {"path": ".\\big.log", "startLine": 2400, "endLine": 9999}),
        ("list_directory", {}), ("list_directory", {"path": "Src20"}), ("find_files", {"glob": "**/*.txt"}), ("find_files", {"glob": "*.MD", "path": "./src/"}), ("file_tree", {}), ("file_tree", {"path": "docs", "maxDepth": 1}),
        ("grep", {"pattern": "tok.n|^password"}), ("grep", {"pattern": "tok.n|^password", "pathGlob": "src/**", "maxMatches": 3}), ("grep", {"pattern": "nothing"}), ("grep", {"pattern": "^$"}),
        ("file_tree", {"path": "src", "maxDepth": 0}), ("read_range", {"path": "big.log", "startLine": 5000, "endLine": 5001}),
    ]
    got, _, _ = answers(spark, tree, calls)
    lines = files.lines_of(tree.filter("text IS NOT NULL"))
    texts = lambda i: [t for _, t, _, _ in got[i]]
    assert got[0] == [(None, None, None, "path_escape")]
    big = [r.line for r in files.read_file(lines.filter("path = 'big.log'")).orderBy("line_no").collect()]
    assert texts(1) == big and {m for _, _, m, _ in got[1]} == {500}
    assert len(texts(2)) == 101 and {m for _, _, m, _ in got[2]} == {0}
    for i, folder in ((3, ""), (4, "Src20")):
        single = files.list_directory(tree, folder).orderBy("n").collect()
        assert texts(i) == [f"{r.name}\t{'directory' if r.is_dir else 'file'}\t{0 if r.is_dir else r.size}" for r in single]
    assert texts(5) == [r.path for r in files.find_files(tree, "**/*.txt").orderBy("n").collect()]
    assert texts(6) == [r.path for r in files.find_files(tree, "*.MD", "src").orderBy("n").collect()]
    show = lambda r: "  " * r.depth + r.path.split("/")[-1] + ("/" if r.is_dir else "")
    assert texts(7) == ["."] + [show(r) for r in files.file_tree(tree).orderBy("n").collect()]
    below = tree.filter("path LIKE 'docs/%'").withColumn("path", F.expr("substring(path, 6)"))
    assert texts(8) == ["docs"] + [show(r) for r in files.file_tree(below, 1).orderBy("n").collect()]
    for i, pattern, glob, cap in ((9, "tok.n|^password", "**", 100), (10, "tok.n|^password", "src/**", 3), (12, "^$", "**", 100)):
        single = files.grep(tree.filter(F.col("path").rlike(files.glob_regex(glob)) & F.col("text").isNotNull()), pattern, cap)
        single = single.orderBy("n").select("more", files.grep_block(*(F.col(c) for c in ("path", "line_no", "line", "previous", "next"))).alias("block")).collect()
        assert texts(i) == [r.block for r in single] and {m for _, _, m, _ in got[i]} == {r.more for r in single}
    assert got[11] == [] and texts(13) == ["src"] and got[14] == []


def test_errors(spark, tree):
    calls = [
        ("rm", {}), (None, {}), ("web_fetch", {}), ("read_file", "{"), ("read_file", None), ("read_file", "[1]"), ("read_file", {"path": "/etc"}), ("read_file", {"path": "C:\\x"}), ("read_file", {"path": "src"}),
        ("read_file", {"path": "bin/x.dat"}), ("read_range", {"path": "big.log"}), ("read_range", {"path": "big.log", "startLine": 2, "endLine": 1}), ("find_files", {}), ("find_files", {"glob": "*", "path": "no"}),
        ("file_tree", {"maxDepth": -1}), ("grep", {}), ("grep", {"pattern": "("}), ("grep", {"pattern": "a", "maxMatches": 0}), ("grep", {"pattern": r"(a)\1"}), ("list_directory", {"path": "big.log"}),
    ]
    wanted = [
        "unknown_tool", "unknown_tool", "outside_effect", "invalid_arguments", "invalid_arguments", "invalid_arguments", "path_escape", "path_escape", "file_not_found", "binary_file", "invalid_range", "invalid_range",
        "glob_required", "directory_not_found", "invalid_max_depth", "pattern_required", "invalid_regex", "invalid_max_matches", "invalid_regex", "directory_not_found",
    ]
    got, frame, rows = answers(spark, tree, calls)
    assert [[x[3] for x in g] for g in got] == [[w] for w in wanted] and set(wanted) == set(dispatch.MESSAGES)
    said = {r.call_id: r.result for r in dispatch.tool_results(frame, rows).collect()}
    assert said["0"] == "Error: unknown tool" and len(said) == len(calls)


def test_results_as_text(spark, tree):
    calls = [("read_file", {"path": "big.log"}), ("list_directory", {"path": "docs"}), ("grep", {"pattern": "alpha", "maxMatches": 2}), ("read_file", {"path": "src/empty.txt"}), ("list_directory", {"path": "bin"})]
    _, frame, rows = answers(spark, tree, calls)
    said = {r.call_id: r.result for r in dispatch.tool_results(frame, rows).collect()}
    assert said["0"].endswith("line\n[... truncated: 500 more lines; cap 2000 lines hit ...]") and said["0"].count("\n") == 2000
    assert said["1"] == "name\ttype\tsizeBytes\na\tdirectory\t0" and said["3"] == "" and said["4"] == "name\ttype\tsizeBytes\nx.dat\tfile\t9"
    assert re.search(r"\n\n.*\n\[\.\.\. truncated: \d+ more matches; cap 2 matches hit \.\.\.\]$", said["2"], re.S)


def test_no_calls_and_no_files(spark, tree):
    none = spark.createDataFrame([], "call_id string, tool string, arguments string")
    assert dispatch.dispatch(none, tree).count() == 0
    got, _, _ = answers(spark, tree.limit(0), [("list_directory", {}), ("grep", {"pattern": "a"}), ("read_file", {"path": "a"}), ("file_tree", {})])
    assert got == [[], [], [(None, None, None, "file_not_found")], [(1, ".", 0, None)]]


def test_catastrophic_patterns_end(spark):
    """A pattern that takes a backtracking search exponential time is linear here; one that needs backtracking is an error."""
    table = spark.createDataFrame([("a.txt", 1, "a" * 20_000 + "b\n" + "a" * 30)], "path string, length long, text string")
    began = time.time()
    got, _, _ = answers(spark, table, [("grep", {"pattern": "^(a+)+$"}), ("grep", {"pattern": "(?=a)a"})])
    assert [g[0][3] for g in got] == [None, "invalid_regex"] and got[0][0][1].startswith("a.txt:2: ") and time.time() - began < 60


def test_grep_does_not_exchange(spark):
    plan = files.grep_all(spark.createDataFrame([("a", "b")], "path string, text string"), "token")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
