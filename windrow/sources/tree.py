"""A data source for file trees: all files, also empty and hidden ones, links checked against the root, reading that stops at the last line asked for.

    spark.dataSource.register(TreeSource)
    spark.read.format("windrow_tree").option("path", root).option("max_lines", "200").load()

Folders near the root are listed by the driver until there are enough of them; what lies below is walked and read in
the tasks, a range of folders in each, so neither the list of files nor a file passes through the driver. The file
system is taken from the path's scheme; a path without one is a folder that all executors see.
"""

from __future__ import annotations

import codecs
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, modified timestamp, text string, more boolean"
#: Bytes in which a NUL makes a file binary, and bytes read at a time.
PROBE, PIECE = 4096, 1 << 16


@dataclass
class _Folders(InputPartition):
    """whole: folders to walk to the bottom; flat: folders of which only the files themselves are taken."""

    whole: list[str]
    flat: list[str]


def open_root(path: str) -> tuple[pafs.FileSystem, str]:
    system, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return system, root.rstrip("/") or "/"


def stays_below(system: pafs.FileSystem, path: str, root: str) -> bool:
    """Whether a path, its links resolved, lies below the root. Only local file systems have links."""
    if not isinstance(system, pafs.LocalFileSystem):
        return True
    from os.path import realpath

    real, top = realpath(path), realpath(root)
    return real == top or real.startswith(top.rstrip("/") + "/")


def is_link(system: pafs.FileSystem, path: str) -> bool:
    from os.path import islink

    return isinstance(system, pafs.LocalFileSystem) and islink(path)


class TreeReader(DataSourceReader):
    """Options: path; content (`text`, or `none` for a listing); max_lines (all, if unset); partitions (32)."""

    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "text")
        self.max_lines, self.wanted = int(options.get("max_lines", 0)) or None, int(options.get("partitions", 32))

    def partitions(self) -> list[InputPartition]:
        system, root = open_root(self.root)
        whole, flat = [root], []
        while whole and len(whole) < self.wanted:  # a level deeper, while that gives more folders
            deeper = [i.path for folder in whole for i in self._entries(system, folder, root) if i.type == pafs.FileType.Directory and not is_link(system, i.path)]
            flat += whole
            whole = sorted(deeper)
        parts = [_Folders(whole[i :: self.wanted], flat[i :: self.wanted]) for i in range(self.wanted)]
        return [p for p in parts if p.whole or p.flat] or [_Folders([], [root])]

    def _entries(self, system: pafs.FileSystem, folder: str, root: str) -> list[pafs.FileInfo]:
        found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=folder != root))
        return sorted((i for i in found if not is_link(system, i.path) or stays_below(system, i.path, root)), key=lambda i: i.path)

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        system, root = open_root(self.root)
        todo = [(folder, False) for folder in partition.flat] + [(folder, True) for folder in partition.whole]
        rows, size = [], 0
        while todo:
            folder, deep = todo.pop()
            for info in self._entries(system, folder, root):
                if info.type == pafs.FileType.Directory:
                    if deep and not is_link(system, info.path):  # links to folders are not followed, so the walk ends
                        todo.append((info.path, True))
                elif info.type == pafs.FileType.File:
                    text, more = self._text(system, info.path) if self.content == "text" else (None, None)
                    rows.append((posixpath.relpath(info.path, root), info.size, info.mtime, text, more))
                    size += len(text or "")
                    if len(rows) == 4096 or size > 1 << 24:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _text(self, system: pafs.FileSystem, path: str) -> tuple[str | None, bool | None]:
        """The text up to the end of the last line asked for, null for a binary file; and whether there is more. Bytes that are no UTF-8 are replaced."""
        decoder, out, lines = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
        with system.open_input_stream(path) as stream:
            piece = stream.read(PROBE)
            if b"\x00" in piece:
                return None, None
            while piece:
                ends = piece.count(b"\n")
                if self.max_lines is not None and lines + ends >= self.max_lines:
                    at = -1
                    for _ in range(self.max_lines - lines):
                        at = piece.index(b"\n", at + 1)
                    return "".join([*out, decoder.decode(piece[: at + 1], True)]), at + 1 < len(piece) or bool(stream.read(1))
                lines += ends
                out.append(decoder.decode(piece))
                piece = stream.read(PIECE)
        return "".join([*out, decoder.decode(b"", True)]), False

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], ["path", "length", "modified", "text", "more"])


class TreeSource(DataSource):
    """path (relative), length, modified, text and more: whether lines follow the text. A link is taken as the file it leads to, if that lies below the root; others are left out."""

    @classmethod
    def name(cls) -> str:
        return "windrow_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
