"""File operators: listings, trees, globs, line ranges and grep over DataFrames of files.

A file table has path (relative, with `/`), length and content (bytes), as load_files makes it; a line
table has path, line_no (from 1) and line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions.text import escapes_root, normalize_newlines, normalize_path


def load_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder, but for names that begin with `_` or `.`, which Spark takes for hidden, and for empty files, which it does not read. Content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")
    return files.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def is_binary(content: Column) -> Column:
    """A NUL among the first 4096 bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 4096)) > 0


def pieces(text: Column) -> Column:
    """The lines of a file's text as an array; the empty piece after a final line feed is no line."""
    parts = F.split(normalize_newlines(text), "\n")
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def between_line_feeds(text: Column) -> Column:
    """What stands between line feeds, as SQL's string_split has it: an empty text is one empty line, as is what follows a final line feed, and a carriage return is kept."""
    return F.split(text, "\n")


def lines_of(texts: DataFrame, path: str = "path", text: str = "text", split: Callable[[Column], Column] = pieces) -> DataFrame:
    """path, line_no and line; the lines are those of a file unless told otherwise."""
    return texts.select(F.col(path).alias("path"), F.posexplode(split(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def read_file(lines: DataFrame, cap: int = 2000) -> DataFrame:
    """The first `cap` lines of each file."""
    return lines.filter(F.col("line_no") <= cap)


def read_range(lines: DataFrame, start: int, end: int, cap: int = 2000) -> DataFrame:
    """Lines start to end, both included, `cap` at most."""
    if start < 1 or end < start:
        raise ValueError("a range starts at 1 or later and does not end before its start")
    return lines.filter(F.col("line_no").between(start, min(end, start + cap - 1)))


def _first(rows: DataFrame, cap: int, *order: Column | str) -> DataFrame:
    """The first `cap` rows in order with their number n, and how many rows there are (all). Only those rows meet in one task."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).limit(cap).withColumn("n", F.row_number().over(Window.orderBy(*order))).withColumn("all", total)


def list_directory(files: DataFrame, folder: str = "", cap: int = 500) -> DataFrame:
    """name, is_dir and size of the entries of one folder: folders first, then by name without regard to case; and how many more there are."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    inside = files.filter(F.col("path").startswith(prefix)).select(F.substring("path", len(prefix) + 1, 2**31 - 1).alias("rest"), "length")
    entry = F.split("rest", "/")
    entries = inside.groupBy(entry[0].alias("name"), (F.size(entry) > 1).alias("is_dir")).agg(F.sum("length").alias("size"))
    first = _first(entries, cap, F.col("is_dir").desc(), F.upper("name"), F.col("name"))
    return first.select("name", "is_dir", F.when(~F.col("is_dir"), F.col("size")).alias("size"), "n", F.greatest(F.col("all") - cap, F.lit(0)).alias("more"))


def file_tree(files: DataFrame, max_depth: int = 2**30, cap: int = 1000) -> DataFrame:
    """Nodes of the tree, in the order in which it is walked (folders first), with their depth from 1; `cap` at most."""
    parts = F.split("path", "/")
    nodes = files.select(parts.alias("parts"), F.size(parts).alias("deep")).select("parts", "deep", F.explode(F.sequence(F.lit(1), F.least("deep", F.lit(max_depth)))).alias("depth"))
    node = F.slice("parts", 1, F.col("depth"))
    nodes = nodes.select(F.array_join(node, "/").alias("path"), "depth", (F.col("depth") < F.col("deep")).alias("is_dir"), node.alias("parts")).dropDuplicates(["path"])
    step = F.transform("parts", lambda p, i: F.concat(F.when((i + 1 < F.size("parts")) | F.col("is_dir"), F.lit("0")).otherwise(F.lit("1")), F.upper(p), F.lit("\x00"), p))
    return _first(nodes.select("path", "depth", "is_dir", step.alias("step")), cap, "step").select("n", "path", "depth", "is_dir")


def glob_regex(glob: str) -> str:
    """`*` within a name, `**` across folders, without regard to case."""
    out, i = [], 0
    glob = re.sub(r"^\./", "", glob.replace("\\", "/"))
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append("[^/]*" if glob[i] == "*" else re.escape(glob[i]))
            i += 1
    return "(?is)^" + "".join(out) + "$"


def find_files(files: DataFrame, glob: str, folder: str = "", cap: int = 500) -> DataFrame:
    """Paths that match a glob, in order without regard to case; `cap` at most, and how many more there are."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    found = files.filter(F.col("path").startswith(prefix) & F.substring("path", len(prefix) + 1, 2**31 - 1).rlike(glob_regex(glob)))
    return _first(found.select("path"), cap, F.upper("path"), F.col("path")).select("n", "path", F.greatest(F.col("all") - cap, F.lit(0)).alias("more"))


def grep_all(texts: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    """All matching lines with the lines before and after. Lines are matched inside the text's array, so only matches become rows and nothing is exchanged. Only a line feed ends a line, also for `.` and `$`."""
    re.compile(pattern)
    lines = texts.select(F.col(path).alias("path"), pieces(F.col(text)).alias("lines"))
    found = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(f"(?d){pattern}"), i)), lambda i: i.isNotNull())
    # lines stands beside the expression that reads it, so that it is made once for a text
    hits = lines.withColumn("hits", found).withColumn("many", F.size("lines")).filter(F.size("hits") > 0).select("path", "lines", "many", F.explode("hits").alias("i"))
    near = lambda i: F.get("lines", i)
    return hits.select("path", (F.col("i") + 1).alias("line_no"), near(F.col("i")).alias("line"), F.when(F.col("i") > 0, near(F.col("i") - 1)).alias("previous"), near(F.col("i") + 1).alias("next"))


def grep(texts: DataFrame, pattern: str, cap: int = 100) -> DataFrame:
    """The first `cap` matches in order of path and line, how many there are and how many more than the cap."""
    first = _first(grep_all(texts, pattern), cap, F.upper("path"), F.col("path"), F.col("line_no"))
    return first.select("n", "path", "line_no", "line", "previous", "next", F.col("all").alias("matches"), F.greatest(F.col("all") - cap, F.lit(0)).alias("more"))


def grep_block(path: Column, line_no: Column, line: Column, previous: Column, following: Column) -> Column:
    """One match as it is shown."""
    here = F.concat(path, F.lit(":"), line_no, F.lit(": "), line)
    before = F.when(previous.isNotNull(), F.concat(F.lit("\n  "), line_no - 1, F.lit("| "), previous)).otherwise("")
    after = F.when(following.isNotNull(), F.concat(F.lit("\n  "), line_no + 1, F.lit("| "), following)).otherwise("")
    return F.concat(here, before, F.lit("\n> "), line_no, F.lit("| "), line, after)


def directory_size(files: DataFrame, sidecar: str = ".workspace.json") -> DataFrame:
    """Bytes of all files but the metadata sidecar."""
    return files.filter(~F.col("path").rlike("(^|/)" + re.escape(sidecar) + "$")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def last_lines(lines: DataFrame, keep: int = 200) -> DataFrame:
    """The last `keep` lines of each file."""
    return lines.withColumn("from_end", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line_no")))).filter(F.col("from_end") <= keep).drop("from_end")


def guarded(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path stays below the root, normalized."""
    return paths.filter(~escapes_root(F.col(column))).withColumn(column, normalize_path(F.col(column)))


def write_text(df: DataFrame, path: str, mode: str = "create") -> None:
    """Write a text column: `create` fails if the target is there, `replace` and `append` do as they say."""
    df.write.mode({"create": "errorifexists", "replace": "overwrite", "append": "append"}[mode]).text(path)
