"""A sink that writes one file a row: df.write.format("quiltra_files").mode("append").save(folder) of (name, content).

Tasks write aside and the commit renames, so a task that is lost or run twice
leaves no half file; files of one name replace each other.  Any store that
Arrow's file systems know will do; the folder has to be one that all executors
share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "quiltra_files"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> Written:
        store, top = _store(self.folder)
        aside = f"{top}/_writing-{uuid.uuid4().hex}"
        store.create_dir(aside)
        files = []
        for k, row in enumerate(rows):
            if row["content"] is None or row["name"] is None:
                raise ValueError(f"a file needs a name and content: {row['name']!r}")
            if "/" in row["name"]:
                raise ValueError(f"not a file name: {row['name']!r}")
            with store.open_output_stream(f"{aside}/{k}") as out:
                out.write(bytes(row["content"]))
            files.append((f"{aside}/{k}", row["name"]))
        return Written([(aside, ""), *files])

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.folder)
        names = [name for message in filter(None, messages) for _, name in message.files[1:]]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        for message in filter(None, messages):
            for path, name in message.files[1:]:
                store.move(path, f"{top}/{name}")
            store.delete_dir(message.files[0][0])

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.folder)
        for message in filter(None, messages):
            store.delete_dir(message.files[0][0])


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("the sink takes columns name and content")
        return FileWriter(self.options["path"].rstrip("/"))


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files; a null or a name given twice is an error, and nothing is written."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format(NAME).mode("append").save(folder)
