"""The file tree source against a walk of the tree."""

import os

import pytest

from windrow.sources import files
from windrow.sources.tree import TreeSource


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    outside = tmp_path_factory.mktemp("outside")
    (outside / "secret.txt").write_text("no")
    for i in range(40):
        folder = top / f"d{i % 7}" / ("deep/er" if i % 3 else "") / (".hidden" if i % 5 == 0 else "x")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.txt").write_text("line\n" * i)
    (top / "empty.txt").write_bytes(b"")
    (top / ".dot").write_text("a\nb")
    (top / "_under").write_text("é\n")
    (top / "bin.dat").write_bytes(b"x\x00y")
    (top / "long.txt").write_text("0123456789\n" * 30_000 + "end")
    (top / "bad.txt").write_bytes(b"\xff\n")
    (top / "none").mkdir()
    (top / "in.txt").symlink_to(top / ".dot")
    (top / "out.txt").symlink_to(outside / "secret.txt")
    (top / "outdir").symlink_to(outside)
    (top / "loop").symlink_to(top)
    return top


def walk(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            if os.path.realpath(path).startswith(str(root)):
                found[os.path.relpath(path, root)] = open(path, "rb").read()
    return found


def load(spark, root, **options):
    spark.dataSource.register(TreeSource)
    return spark.read.format("windrow_tree").option("path", str(root)).options(**options).load()


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_all_files_as_a_walk_finds_them(spark, root, partitions):
    want = walk(root)
    rows = load(spark, root, partitions=partitions).collect()
    assert len(rows) == len(want) and {r.path: r.length for r in rows} == {p: len(b) for p, b in want.items()}
    for r in rows:
        body = want[r.path]
        assert r.text == (None if b"\x00" in body[:4096] else body.decode("utf-8", "replace")) and r.more in (False, None)
    assert {"empty.txt", ".dot", "_under", "in.txt", "bad.txt"} <= {r.path for r in rows} and not any("out" in r.path for r in rows)


def test_reading_stops_at_the_last_line(spark, root):
    rows = {r.path: r for r in load(spark, root, max_lines=2).collect()}
    assert (rows["long.txt"].text, rows["long.txt"].more) == ("0123456789\n" * 2, True)
    assert (rows[".dot"].text, rows[".dot"].more) == ("a\nb", False) and (rows["_under"].text, rows["_under"].more) == ("é\n", False)
    far = {r.path: r for r in load(spark, root, max_lines=20_000).collect()}["long.txt"]
    assert far.text == "0123456789\n" * 20_000 and far.more
    lines = files.lines_of(load(spark, root, max_lines=5).filter("text IS NOT NULL"))
    assert {r.line for r in files.read_range(lines.filter("path = 'long.txt'"), 3, 5).collect()} == {"0123456789"}


def test_listing_and_tree_operators(spark, root):
    listing = load(spark, root, content="none")
    assert listing.filter("text IS NOT NULL").count() == 0
    assert [r.name for r in files.list_directory(listing).orderBy("n").collect()][:7] == [f"d{i}" for i in range(7)]
    assert files.directory_size(listing).first()[0] == sum(len(b) for b in walk(root).values())


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such"):
        load(spark, tmp_path / "nowhere").count()
