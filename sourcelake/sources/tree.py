"""Source trees on a file system of the driver: a sorted walk of names, then distributed reads of the bytes."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelake.functions.paths import EXCLUDED_DIRECTORIES, glob_regex

MAX_FILE_SIZE, MAX_FILES, MAX_DEPTH = 2 << 20, 100_000, 64
MAX_TOTAL_BYTES, MAX_METADATA_BYTES = 1 << 30, 64 << 20
# Fixed value: the charge for one file beside its path.
FILE_CHARGE = 256


def walk(root: str, excludes: list[str] = (), max_file_size: int = MAX_FILE_SIZE, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH, max_total_bytes: int = MAX_TOTAL_BYTES, max_metadata_bytes: int = MAX_METADATA_BYTES) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """(files, diagnostics): (path, size) in walk order and (code, path). Links and special files are skipped, never followed.

    A file that no longer fits the total bytes is left out and the walk goes on; the metadata budget ends the walk.
    """
    import re

    tests = [(p.startswith("!"), re.compile(glob_regex(p.lstrip("!")))) for p in excludes]
    files, notes = [], []
    room, metadata = max_total_bytes, max_metadata_bytes

    def visit(folder: str, depth: int) -> bool:
        nonlocal room, metadata
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            notes.append(("directory_read_failed", folder))
            return True
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            mode = e.stat(follow_symlinks=False)
            if e.name.lower() == ".git" or (stat.S_ISDIR(mode.st_mode) and e.name in EXCLUDED_DIRECTORIES):
                notes.append(("ignored_engine", path))
                continue
            state = False
            for keep, regex in tests:
                state = (not keep) if regex.match(path) else state
            if state:
                notes.append(("excluded_user", path))
            elif stat.S_ISLNK(mode.st_mode):
                notes.append(("symlink_skipped", path))
            elif stat.S_ISDIR(mode.st_mode):
                if depth + 1 > max_depth:
                    notes.append(("max_depth", path))
                elif not visit(path, depth + 1):
                    return False
            elif not stat.S_ISREG(mode.st_mode):
                notes.append(("special_file_skipped", path))
            elif len(files) >= max_files:
                notes.append(("max_files", path))
                return False
            elif mode.st_size > max_file_size:
                notes.append(("file_too_large", path))
            elif mode.st_size > room:
                notes.append(("max_total_bytes", path))
            elif (charge := FILE_CHARGE + len(os.fsencode(path))) > metadata:
                notes.append(("metadata_budget", path))
                return False
            else:
                room, metadata = room - mode.st_size, metadata - charge
                files.append((path, mode.st_size))
        return True

    visit("", 0)
    return files, notes


def _reader(base: str):
    def read(path: str) -> bytes | None:
        try:
            with os.fdopen(os.open(os.path.join(base, path), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as f:
                return f.read() if stat.S_ISREG(os.fstat(f.fileno()).st_mode) else None
        except OSError:
            return None

    return read


def reread(files: DataFrame, root: str) -> DataFrame:
    """(relative_path, size_bytes, content_hash) of the files as they are now, both null for those that cannot be read."""
    bytes_of = _reader(os.path.abspath(root))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for p in frame.relative_path:
                data = bytes_of(p)  # one file at a time
                rows.append((p, None, None) if data is None else (p, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["relative_path", "size_bytes", "content_hash"]).astype({"size_bytes": "Int64"})

    return files.select("relative_path").mapInPandas(run, "relative_path string, size_bytes long, content_hash string")


def read_tree(spark: SparkSession, root: str, repo_id: str = "", **limits) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics) of a tree that all machines see: doc_id (walk order), repo_id, relative_path and content as bytes."""
    if os.path.islink(root) or not os.path.isdir(root):
        raise ValueError(f"{root} is not a directory")
    found, notes = walk(root, **limits)
    bytes_of = _reader(os.path.abspath(root))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(content=[bytes_of(p) for p in frame.relative_path])

    rows = spark.createDataFrame([(i, repo_id, p) for i, (p, _) in enumerate(found)], "doc_id long, repo_id string, relative_path string")
    files = rows.mapInPandas(read, "doc_id long, repo_id string, relative_path string, content binary")
    return files, spark.createDataFrame(notes, "code string, relative_path string").withColumn("repo_id", F.lit(repo_id))
