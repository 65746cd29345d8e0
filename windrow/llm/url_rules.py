"""URL filters: a sort-merge range join of URLs with host and path rules.

The key of a host is its labels from the last to the first, each followed by a dot: `www.example.com`
has the key `com.example.www.`. The hosts under a rule's host are then exactly the keys that start
with the rule's key, an interval in sorted order, and the intervals of any two rules are nested or
apart. A sweep over the sorted keys of both sides holds the open intervals on a stack; every rule on
the stack fits the host of the URL at hand. The paths of one host's rules are intervals of the same
kind: the longest that a URL's path starts with is found by binary search for the path and the chain of
prefixes around the place, whatever the number of rules.

The URLs are not shuffled: each Arrow batch is sorted and swept on its own against the sorted rules.
Rules are broadcast in blocks of `rules_at_once`; more rules than that are swept in as many passes. A
pass keeps the longer of its rule and the one found so far by the same measure as within a block, so the
block size changes no verdict and no task ever holds more than one block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: (length of host and path, length of host, host and path, verdict): the greatest wins
Found = tuple[int, int, str, str]


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class HostRules:
    """The path rules of one host, sorted, each with the longest other path that it starts with."""

    def __init__(self, host: str, verdicts: dict[str, str]):
        self.paths = sorted(verdicts)
        self.found: list[Found] = [(len(host) + len(p), len(host), host + p, verdicts[p]) for p in self.paths]
        self.outer: list[int] = []
        for at, path in enumerate(self.paths):
            near = at - 1
            while near >= 0 and not path.startswith(self.paths[near]):
                near = self.outer[near]
            self.outer.append(near)

    def longest(self, path: str) -> Found | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.found[at] if at >= 0 else None


def sweep(keys: Sequence[str], paths: Sequence[str], rules: Sequence[tuple[str, HostRules]]) -> Iterator[Found | None]:
    """For each of the sorted keys, with its path, the longest rule that fits, or None. rules: sorted by key."""
    stack: list[tuple[str, HostRules]] = []
    at = 0
    for key, path in zip(keys, paths):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        yield max((f for _, host in stack if (f := host.longest(path)) is not None), default=None)


def rule_blocks(rules: Sequence[Rule], size: int) -> Iterator[list[tuple[str, HostRules]]]:
    """The distinct rules by key, `size` at most at a time. Of equal rules with different verdicts the blocking one stays."""
    verdicts: dict[tuple[str, str, str], str] = {}
    for verdict, host, path in rules:
        place = reversed_key(host), host, path
        if verdicts.get(place) != "block":
            verdicts[place] = "block" if verdict == "block" else "allow"
    ordered = sorted(verdicts)
    for start in range(0, len(ordered), size):
        by_host: dict[tuple[str, str], dict[str, str]] = {}
        for key, host, path in ordered[start : start + size]:
            by_host.setdefault((key, host), {})[path] = verdicts[key, host, path]
        yield [(key, HostRules(host, paths)) for (key, host), paths in by_host.items()]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", rules_at_once: int = 50_000) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages (page_id, url).

    A rule (verdict, host, path) fits its host and all hosts below it where the URL's path starts with
    the rule's. The longest rule (host and path together, then host) wins; two equal rules with
    different verdicts block. A null URL and one without `://` has empty host and path and is judged
    like any other, so by default it is allowed without a rule. A null page_id is kept. One row comes
    back for each row given, repeated rows included; other columns are not carried. URLs of any length
    are compared whole.
    """
    context = pages.sparkSession.sparkContext
    out = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("of_host"), F.lit(default).alias("verdict"),
    )
    schema = "page_id long, host string, path string, rule string, of_host int, verdict string"
    for block in rule_blocks(rules, rules_at_once):
        shared = context.broadcast(block)  # rules_at_once rules at most

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "path"):
                    keys, paths = [reversed_key(h) for h in part.column("host").to_pylist()], part.column("path").to_pylist()
                    names, lengths, verdicts = (part.column(c).to_pylist() for c in ("rule", "of_host", "verdict"))
                    order = sorted(range(len(keys)), key=keys.__getitem__)
                    for row, best in zip(order, sweep([keys[k] for k in order], [paths[k] for k in order], shared.value)):
                        if best is not None and (names[row] is None or best[:2] > (len(names[row]), lengths[row])):
                            _, lengths[row], names[row], verdicts[row] = best
                    found = {"rule": pa.array(names, pa.string()), "of_host": pa.array(lengths, pa.int32()), "verdict": pa.array(verdicts, pa.string())}
                    yield pa.record_batch({c: part.column(c) for c in ("page_id", "host", "path")} | found)

        out = out.mapInArrow(apply, schema)
    return out.drop("of_host")
