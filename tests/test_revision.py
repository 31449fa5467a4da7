"""A git revision read by subtrees, against what git itself lists."""

import os
import subprocess

import pytest

from tessera.sources import revision


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")
    for k in range(30):
        folder = root / f"d{k % 4}" / f"e{k % 3}" / ("deep/" * (k % 5))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"n{k}.md").write_bytes(b"" if k == 7 else f"note {k}\n".encode() * (k + 1))
    (root / "top é.md").write_text("at the top")
    (root / "line\nbreak.md").write_text("odd name")
    (root / "d1" / "skip.txt").write_text("not a note")
    (root / "d1" / "raw.md").write_bytes(bytes(range(256)))
    os.symlink("d1/raw.md", root / "link.md")
    git("add", "-A")
    git("commit", "-qm", "one")
    first = git("rev-parse", "HEAD")
    (root / "d1" / "raw.md").unlink()
    (root / "later.md").write_text("later")
    git("add", "-A")
    git("commit", "-qm", "two")
    return root, first


def listed(root, at, suffix=".md"):
    names = subprocess.run(["git", "-C", str(root), "ls-tree", "-r", "-z", "--name-only", at], capture_output=True, check=True).stdout.decode().split("\0")
    return {n: subprocess.run(["git", "-C", str(root), "show", f"{at}:{n}"], capture_output=True, check=True).stdout for n in names if n.endswith(suffix)}


@pytest.mark.parametrize("partitions", [1, 5, 64])
def test_the_files_are_those_that_git_lists(spark, repository, partitions):
    root, first = repository
    for at in (first, "HEAD", "main"):
        rows = revision.scan_revision(spark, str(root), at, partitions=partitions).collect()
        assert {r["path"]: bytes(r["content"]) for r in rows} == listed(root, at) and len(rows) == len(listed(root, at))


def test_globs_and_revisions_that_are_not_there(spark, repository):
    root, first = repository
    some = revision.scan_revision(spark, str(root), first, ["d1/**/*.md", "*.txt", "d1/*.txt"]).collect()
    assert {r["path"] for r in some} == {n for n in listed(root, first, "") if n.startswith("d1/") and n.endswith((".md", ".txt"))}
    assert revision.scan_revision(spark, str(root), "nowhere").collect() == [] == revision.scan_revision(spark, str(root), "--help").collect()


def test_the_driver_lists_no_files(repository):
    root, first = repository
    reader = revision.RevisionReader({"repository": str(root), "revision": first, "partitions": "6"})
    parts = reader.partitions()
    assert len(parts) >= 5 and {p.prefix for p in parts} >= {b"d0/", b"d3/"} and sum(len(list(reader.read(p))) for p in parts) == len(listed(root, first))
