"""Folders listed and files hashed by tasks.

Spark's own file sources pass over names that begin with a dot or an
underscore and read a file whole; here every file counts and is read in
blocks.  Local paths are read by the operating system, which knows links;
other stores through Arrow's file systems, which every executor can reach.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.request import url2pathname

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import cut_lineage

BLOCK = 4 << 20
ENTRY = "path string, is_folder boolean, length long, modified_us long"


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    if parts.scheme == "file":
        return url2pathname(parts.path)
    return path if not parts.scheme else None


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    own = _local(folder)
    if own is not None:
        with os.scandir(own) as found:
            for entry in found:
                if not entry.is_symlink():
                    facts = entry.stat(follow_symlinks=False)
                    yield entry.path, entry.is_dir(), facts.st_size, facts.st_mtime_ns // 1000
        return
    store, inside = fs.FileSystem.from_uri(folder)
    start = folder[: len(folder) - len(inside)]
    for entry in store.get_file_info(fs.FileSelector(inside)):
        yield start + entry.path, entry.type == fs.FileType.Directory, entry.size or 0, (entry.mtime_ns or 0) // 1000


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["path"]:
            yield pd.DataFrame(_entries(folder), columns=["path", "is_folder", "length", "modified_us"])


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, length and modified_us of all files below a directory; one job for each level of folders."""
    folders = spark.createDataFrame([(directory,)], "path string")
    levels: list[DataFrame] = []
    while True:
        level = cut_lineage(folders.mapInPandas(_listed, ENTRY))
        levels.append(level.filter(~F.col("is_folder")))
        inner = level.filter("is_folder").select("path")
        if inner.isEmpty():
            break
        folders = inner.repartition("path")
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("path", "length", "modified_us")


def _blocks(path: str) -> Iterator[bytes]:
    own = _local(path)
    if own is not None:
        source = open(own, "rb")  # noqa: SIM115
    else:
        store, inside = fs.FileSystem.from_uri(path)
        source = store.open_input_stream(inside)
    with source:
        while block := source.read(BLOCK):
            yield block


@F.pandas_udf(T.StringType())
def _hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for paths in batches:
        hashes = []
        for path in paths:
            made = hashlib.sha256()
            for block in _blocks(path):
                made.update(block)
            hashes.append(made.hexdigest())
        yield pd.Series(hashes)


def with_hash(files: DataFrame, path: str, name: str) -> DataFrame:
    """Adds the SHA-256 of each file; files are dealt out anew, as some folders hold most of them."""
    return files.repartition(path).withColumn(name, _hash(F.col(path)))


def _put(path: str, body: bytes | None) -> None:
    own = _local(path)
    if own is not None:
        if body is None:
            os.remove(own)
            return
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(own, "wb") as out:
            out.write(body)
        return
    store, inside = fs.FileSystem.from_uri(path)
    if body is None:
        store.delete_file(inside)
        return
    store.create_dir(os.path.dirname(inside), recursive=True)
    with store.open_output_stream(inside) as out:
        out.write(body)


def _put_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, body in zip(batch["path"], batch["body"], strict=True):
            _put(path, None if body is None else bytes(body))
        yield batch[["path"]]


def put_files(files: DataFrame) -> None:
    """Write a file for each row (path, body), by tasks; a NULL body removes the file.

    A repeated task writes the same bytes again; removing is not repeatable, so
    files are removed by a call of their own, once.
    """
    rows = files.select("path", F.col("body").cast("binary").alias("body"))
    rows.mapInPandas(_put_all, "path string").write.format("noop").mode("overwrite").save()
