"""A vault as it was at a revision of its git repository, read from the object store without a checkout."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import glob_pattern

_SCHEMA = "path string, content binary"


@dataclass
class Subtree(InputPartition):
    """A tree object and the path that it is at; without ``deep`` only the files in it."""

    tree: str
    prefix: bytes
    deep: bool


class RevisionSource(DataSource):
    """``spark.read.format("git_revision")``: files of a revision whose path matches, a partition for each subtree.

    Options: ``repository``, ``revision``, ``include`` (globs, one a line) and ``partitions``. The
    driver reads the names of subtrees only, level by level until there are about that many;
    each task lists and reads its own. The repository must lie where all executors see it. A
    revision that does not resolve has no files.
    """

    @classmethod
    def name(cls) -> str:
        return "git_revision"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RevisionReader(self.options)


class RevisionReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repository, self.revision = options["repository"], options["revision"]
        self.include = [re.compile(glob_pattern(g), re.DOTALL) for g in options.get("include", "**/*.md").split("\n")]
        self.wanted = int(options.get("partitions", "64"))

    def _entries(self, tree: str, *how: str) -> Iterator[tuple[str, str, bytes]]:
        """(type, object, name) of what ``git ls-tree`` says of a tree; nothing where it fails."""
        listed = subprocess.run(["git", "-C", self.repository, "ls-tree", "-z", "--full-tree", *how, "--end-of-options", tree], capture_output=True, check=False)
        for entry in listed.stdout.split(b"\0") if listed.returncode == 0 else ():
            about, _, name = entry.partition(b"\t")
            if name:
                _, kind, held = about.decode().split()
                yield kind, held, name

    def partitions(self) -> Sequence[InputPartition]:
        done, level = [], [Subtree(self.revision, b"", True)]
        while level and len(done) + len(level) < self.wanted:
            below = []
            for at in level:
                done.append(Subtree(at.tree, at.prefix, False))
                below += [Subtree(held, at.prefix + name + b"/", True) for kind, held, name in self._entries(at.tree, "-d") if kind == "tree"]
            level = below
        return done + level

    def read(self, partition: Subtree) -> Iterator[tuple[str, bytes]]:
        found = []
        for kind, held, name in self._entries(partition.tree, *(["-r"] if partition.deep else [])):
            path = (partition.prefix + name).decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
            if kind == "blob" and any(p.fullmatch(path) for p in self.include):
                found.append((path, held))
        if not found:
            return
        with subprocess.Popen(["git", "-C", self.repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for path, held in found:
                git.stdin.write(held.encode() + b"\n")
                git.stdin.flush()
                size = int(git.stdout.readline().split()[2])
                content = git.stdout.read(size)
                git.stdout.read(1)
                yield path, content
            git.stdin.close()


def scan_revision(spark: SparkSession, repository: str, revision: str, include: Sequence[str] = ("**/*.md",), partitions: int = 64) -> DataFrame:
    """``(path, content)`` of the files of a revision whose path matches, through RevisionSource."""
    spark.dataSource.register(RevisionSource)
    return spark.read.format("git_revision").option("repository", repository).option("revision", revision).option("include", "\n".join(include)).option("partitions", partitions).load()


def first_of_each_id(parsed: DataFrame) -> DataFrame:
    """Parsed notes of a revision, of those that share an id the one of least path; files that are no notes are left out."""
    notes = parsed.where("error_kind is null")
    first = notes.groupBy("note_id").agg(F.min("path").alias("path"))
    return notes.join(first, ["note_id", "path"], "left_semi")
