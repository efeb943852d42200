"""The shared folder: tables and binary files that every executor can reach.

``spark.checkpoint.dir`` names it. Where that is unset, a temporary folder serves a local master,
whose driver and tasks share one disk; on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder ``name-<random>`` in the shared folder; it isn't created yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="probewise-"))
        base = _LOCAL[0]
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once, lineage cut there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_uri(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks, tag: str) -> None:
    """Write byte chunks under a name of this attempt, then move them to ``uri`` in one step."""
    system, path = split_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{tag}"
    with system.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(draft, path)


def read_array(uri: str, dtype: str) -> np.ndarray:
    """A flat binary file as an array: mapped where it lies on a mounted disk, else read."""
    system, path = split_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        empty = system.get_file_info(path).size == 0
        return np.empty(0, dtype) if empty else np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)
