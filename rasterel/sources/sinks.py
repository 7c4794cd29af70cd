"""Files out: a sink that writes (path, content) rows, each file as a whole or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def write_whole(path: str, content: bytes) -> None:
    """Writes a file through a temporary one in the same folder, which then takes its name."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), os.path.abspath(path))
    folder, _, last = name.rpartition("/")
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{last}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(temporary, compression=None) as f:
            f.write(content)
        fs.move(temporary, name)
    except BaseException:
        if fs.get_file_info(temporary).type == pafs.FileType.File:
            fs.delete_file(temporary)
        raise


def write_files(files: DataFrame) -> DataFrame:
    """Writes (path string, content binary) rows; returns (path, bytes) when an action runs it.

    A rerun task writes the same files again. Rows without content are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content is not None:
                    write_whole(path, content)
                    paths.append(path)
                    sizes.append(len(content))
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")
