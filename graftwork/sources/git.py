"""Changed files of two commits, of a commit and the index, or of a commit and the files on disk.

The list of changes comes from git on the driver (names and ids only); contents
are read by executors, which must see the repository at the same path.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.sources.paths import detect_language, glob_match

SCHEMA = "commit STRING, file_path STRING, old_path STRING, status STRING, old_blob STRING, new_blob STRING, old_text STRING, new_text STRING"
_STATUS = {"A": "Added", "D": "Deleted", "M": "Modified", "R": "Renamed"}
_LIST = "commit STRING, file_path STRING, old_path STRING, status STRING, old_blob STRING, new_blob STRING"


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


class Blobs:
    """Contents of objects, all read by one process of git."""

    def __init__(self, repo: str) -> None:
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> Blobs:
        return self

    def __exit__(self, *_: object) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def get(self, oid: str) -> bytes | None:
        """None where there is no such blob."""
        self.process.stdin.write(oid.encode() + b"\n")
        self.process.stdin.flush()
        kind = self.process.stdout.readline().split()
        if len(kind) != 3:
            return None
        data = self.process.stdout.read(int(kind[2]) + 1)[:-1]
        return data if kind[1] == b"blob" else None

    def get_bytes(self, oid: str) -> bytes | None:
        """None for binary contents too: those with a zero in their first 8,000 bytes."""
        data = self.get(oid)
        return None if data is None or b"\0" in data[:8000] else data


def resolve(repo: str, ref: str) -> str:
    return _git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def list_changes(repo: str, a: str = "HEAD~1", b: str | None = "HEAD", staged: bool = False) -> list[tuple]:
    """(commit, path, old path, status, old blob, new blob); kinds of change other than the four are left out."""
    base = resolve(repo, a)
    args = ["diff-index", "--cached", base] if staged else ["diff-index", base] if b is None else ["diff-tree", "-r", base, resolve(repo, b)]
    fields = _git(repo, *args[:1], "-M", "-z", "--raw", "--abbrev=40", *args[1:]).decode("utf-8", "replace").split("\0")
    name = f"{a}..{'index' if staged else b or 'worktree'}"
    out, i = [], 0
    while i < len(fields) and fields[i].startswith(":"):
        _, _, old, new, status = fields[i][1:].split()
        paths = fields[i + 1 : i + (3 if status[0] in "RC" else 2)]
        i += 1 + len(paths)
        if status[0] in _STATUS:
            none = lambda x: None if set(x) == {"0"} else x
            out.append((name, paths[-1], paths[0], _STATUS[status[0]], none(old), none(new)))
    return out


def changed_files(spark: SparkSession, repo: str, a: str = "HEAD~1", b: str | None = "HEAD", staged: bool = False, path: str | None = None) -> DataFrame:
    """Changed files of known languages with both texts; null for a missing side and for what isn't UTF-8. Equal blobs are skipped."""
    changes = spark.createDataFrame(list_changes(repo, a, b, staged), _LIST)
    changes = changes.where(~F.coalesce(F.col("old_blob") == F.col("new_blob"), F.lit(False))).withColumn("lang", detect_language(F.col("file_path"))).where("lang is not null")
    if path:
        changes = changes.where(glob_match(F.col("file_path"), path))
    disk = b is None and not staged

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Blobs(repo) as blobs:

            def text(oid: object, name: str, worktree: bool) -> str | None:
                try:
                    if isinstance(oid, str) and oid:
                        data = blobs.get(oid)
                    elif worktree:
                        with open(os.path.join(repo, name), "rb") as f:
                            data = f.read()
                    else:
                        return None
                    return None if data is None else data.decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    return None

            for x in batches:
                x["old_text"] = [text(o, n, False) for o, n in zip(x["old_blob"], x["old_path"])]
                x["new_text"] = [text(o, n, disk and s != "Deleted") for o, n, s in zip(x["new_blob"], x["file_path"], x["status"])]
                yield x[["commit", "file_path", "old_path", "status", "old_blob", "new_blob", "old_text", "new_text", "lang"]]

    return changes.mapInPandas(read, SCHEMA + ", lang STRING")


SKIPPED = (".git", "node_modules", "target")


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files of known languages under a folder (file_path, lang, text), without build and version folders; null text for what isn't UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    for name in SKIPPED:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    lang = detect_language(F.col("path"))
    return files.where(lang.isNotNull()).select(F.lit("").alias("commit"), F.col("path").alias("file_path"), lang.alias("lang"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))


def two_files(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """A pair out of two files on disk; `.`, `/dev/null` and empty names count as missing."""

    def text(name: str) -> str | None:
        if name in ("", ".", "/dev/null"):
            return None
        with open(name, encoding="utf-8") as f:
            return f.read()

    return spark.createDataFrame([("", path, text(old), text(new))], "commit STRING, file_path STRING, old_text STRING, new_text STRING").withColumn("lang", detect_language(F.col("file_path")))
