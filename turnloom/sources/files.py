"""Files of any content written by tasks: each appears under its name whole or not at all."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

RECEIPT = "path string, bytes long, crc32 long"


def publish(folder: str, name: str, content: bytes) -> None:
    """Writes a file under a hidden name and renames it. A writer that dies leaves a hidden part that no reader lists; a task that is run again puts the same file in its place."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    part = f"{base}/.{name}.part-{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(content)
    where.move(part, f"{base}/{name}")


def place_of(name: str, spread: int) -> str:
    """A folder for a name, so that no folder gets too many files."""
    return f"{zlib.crc32(name.encode()) % spread:03d}"


def publish_files(rows: DataFrame, folder: str, spread: int = 256) -> DataFrame:
    """(path, bytes, crc32) of a file published for each row (name, content binary), in one of `spread` folders by its name.

    folder: a URI that driver and executors share. The files are written when the receipts are read; store these first.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                place = place_of(name, spread)
                publish(f"{folder}/{place}", name, bytes(content))
                out.append((f"{place}/{name}", len(content), zlib.crc32(content)))
            yield pd.DataFrame(out, columns=["path", "bytes", "crc32"])

    return rows.select("name", "content").mapInPandas(write, RECEIPT)


def publish_folders(rows: DataFrame, root: str, spread: int = 256) -> DataFrame:
    """The same for rows (folder, name, content): each file in a folder of its own tree, these dealt over `spread` folders below the root.

    The tasks of `rows` write, each its files, and no committer moves a folder for each of them afterwards: deal the rows by a given number of partitions, as small rows are gathered in one task else.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for folder, name, content in zip(batch["folder"], batch["name"], batch["content"], strict=True):
                place = f"{place_of(folder, spread)}/{folder}"
                publish(f"{root}/{place}", name, bytes(content))
                out.append((f"{place}/{name}", len(content), zlib.crc32(content)))
            yield pd.DataFrame(out, columns=["path", "bytes", "crc32"])

    return rows.select("folder", "name", "content").mapInPandas(write, RECEIPT)
