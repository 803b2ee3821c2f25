"""Pickled tables that executors store in the shared folder, one file a shard, and that tasks read."""

from __future__ import annotations

import pickle
import re

import pyarrow.fs
import pyarrow.parquet


def load_stored(folder: str, shard: int, column: str = "kept"):
    """The object stored under folder/shard=<shard>, read by a task; None for a shard that got nothing."""
    files, path = pyarrow.fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (pyarrow.fs.LocalFileSystem(), folder)
    here = f"{path}/shard={shard}"
    if files.get_file_info(here).type == pyarrow.fs.FileType.NotFound:
        return None
    names = [f.path for f in files.get_file_info(pyarrow.fs.FileSelector(here)) if f.path.endswith(".parquet")]
    return pickle.loads(pyarrow.parquet.read_table(names[0], filesystem=files, partitioning=None)[column][0].as_py())
