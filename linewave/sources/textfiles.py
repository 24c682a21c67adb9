"""Text results as files of given names: a data source writer with a commit in two phases.

Spark's own text writer names its part files itself. Here every file of a result has its name: a task writes the files it is
given to a staging folder of its own attempt, and only when all tasks are done the driver moves what they report to its
place and drops the staging folder, with whatever retried, doubled or failed attempts have left there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.taskcontext import TaskContext

COLUMNS = ["folder", "file", "line", "text"]
STAGING = "_staging"


def _target(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; all executors must share it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri.removeprefix('file:')}")


def _checked(folder: str, file: str) -> str:
    parts = [*folder.split("/"), f"{file}.txt"]
    if any(p in ("", ".", "..") for p in parts) or "/" in file or parts[0] == STAGING:
        raise ValueError(f"not the name of a file below the target: {folder}/{file}")
    return "/".join(parts)


@dataclass
class _Written(WriterCommitMessage):
    """(staged path, path below the target) of the files of one task."""

    files: list[tuple[str, str]]


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = _target(self.path)
        context = TaskContext.get()
        own = f"{root}/{STAGING}/{self.run}/{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        where.create_dir(own, recursive=True)
        files: list[tuple[str, str]] = []
        now, out = None, None
        try:
            for batch in iterator:
                for folder, file, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("folder", "file", "text"))):
                    if (folder, file) != now:
                        if out:
                            out.close()
                        now = (folder, file)
                        files.append((f"{own}/{len(files)}", _checked(folder, file)))
                        out = where.open_output_stream(files[-1][0])
                    out.write(f"{text or ''}\n".encode())
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = _target(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        taken = [i.path for i in where.get_file_info([f"{root}/{n}" for n in names]) if i.type != fs.FileType.NotFound] if files else []
        if len(set(names)) < len(names) or (taken and not self.overwrite):
            self.abort(messages)
            raise FileExistsError(f"a file would be written twice, or is there already: {taken[:3] or [n for n in names if names.count(n) > 1][:3]}")
        for folder in sorted({n.rpartition("/")[0] for n in names}):
            where.create_dir(f"{root}/{folder}", recursive=True)
        for staged, name in files:
            if f"{root}/{name}" in taken:
                where.delete_file(f"{root}/{name}")
            where.move(staged, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Drop the staging folder of this run, and the common one if nothing else is in it."""
        where, root = _target(self.path)
        if where.get_file_info(f"{root}/{STAGING}/{self.run}").type != fs.FileType.NotFound:
            where.delete_dir(f"{root}/{STAGING}/{self.run}")
        if where.get_file_info(f"{root}/{STAGING}").type != fs.FileType.NotFound and not where.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            where.delete_dir(f"{root}/{STAGING}")


class NamedText(DataSource):
    """``format("named_text")``: rows (folder, file, line, text), those of a file together and in order."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"], overwrite)


def save_files(text: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write (folder, file, line, text) rows as the files ``path/folder/file.txt``, UTF-8, the lines in order, each ended.

    A file is written by one task, which holds one line at a time; null texts are empty lines, and folders and files may be named in any
    script but not by ``.``, ``..`` or nothing. A name that is there already is an error, unless ``overwrite``; then it is replaced.
    If any task fails for good, nothing is left. No rows write no files. ``path`` is in a file system that all executors share.
    """
    text.sparkSession.dataSource.register(NamedText)
    rows = text.select(*COLUMNS).repartition("folder", "file").sortWithinPartitions(*COLUMNS)
    rows.write.format("named_text").mode("overwrite" if overwrite else "append").save(path)
