"""Files and tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from newsloom.session import BATCH_ROWS, map_arrow, shared_dir  # noqa: F401


def new_folder(spark: SparkSession, label: str) -> str:
    """The address of a fresh folder below the shared one."""
    return f"{shared_dir(spark)}/newsloom-llm/{label}-{uuid.uuid4().hex}"


def free_name(name: str, taken: list[str], others: list[str] | tuple[str, ...] = ()) -> str:
    """A column's name; if it is ``taken`` (in any case), with as many underscores behind it as keep it apart from all."""
    taken = {t.lower() for t in taken}
    if name.lower() in taken:
        everything = taken | {o.lower() for o in others}
        while name.lower() in everything:
            name += "_"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _local(address: str) -> str | None:
    """The path of an address on a mounted file system, or None for a store that needs a client."""
    url = urlparse(address)
    return url.path if url.scheme in ("", "file") else None


def put(address: str, data: bytes) -> None:
    """Write a file as a whole: a retried task replaces it by the same bytes, and no reader sees half of it."""
    path = _local(address)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(address)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def mapped(address: str, dtype: type) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array; empty where no task had anything to write.

    Only the pages that are looked at are read.

    From a store without a mount the file is read into memory instead; callers open one shard at a time.
    """
    path = _local(address)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(address)
        if store.get_file_info(inner).type == fs.FileType.NotFound:
            return np.zeros(0, dtype=dtype)
        with store.open_input_file(inner) as source:
            return np.frombuffer(source.read(), dtype=dtype)
    if not os.path.exists(path) or os.path.getsize(path) == 0:
        return np.zeros(0, dtype=dtype)
    return np.memmap(path, dtype=dtype, mode="r")
