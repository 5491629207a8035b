"""One named file per document, as a Spark data source for writing.

``df.write.format("named_files").mode("append").save(path)`` with the columns out_name and text writes each row as a UTF-8 file
``path/<export>-<task>/<out_name>``.  A task writes into a folder of its own attempt under ``path/_staging``; only when all tasks
are done does the commit move the folders of the successful attempts to their places (one rename a task, no file passes through
the driver), so a failed or repeated task leaves nothing in their places (tasks
that still run while a failed export is given up may leave files under ``_staging``, which readers pass over).  A row that cannot be written (no text, no usable
name, a name twice in a task) is listed in the task's ``_errors.jsonl`` and the others go on.  Folders are reached through Arrow's file systems, so the path may
name any store that they know.

Reading back, the driver lists the folders of the tasks alone; each folder's files are listed and read by a task of their own, so what
the driver holds grows with the tasks of the export, not with its files.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.batches import MOST_BYTES
from ..session import share_package, shuffles_cleared, small_batches
from .io import decode_utf8

STAGING, ERRORS = "_staging", "_errors.jsonl"


@dataclass
class Written(WriterCommitMessage):
    """What a successful task attempt left: its staging folder, its place, and how many rows."""
    staged: str
    place: str
    files: int
    errors: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _usable(name: str | None) -> bool:
    return bool(name) and "/" not in name and "\\" not in name and "\x00" not in name and name not in (".", "..", ERRORS) and len(name.encode()) <= 255


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.export = path.rstrip("/"), uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        context = TaskContext.get()
        place = f"{self.export}-{context.partitionId():05d}"
        staged = posixpath.join(root, STAGING, f"{place}-{context.taskAttemptId()}")
        store.create_dir(staged, recursive=True)
        names, errors = set(), []
        for row in iterator:
            name, text = row["out_name"], row["text"]
            problem = ("no text" if text is None else "no usable name" if not _usable(name) else "a second file of this name" if name in names else None)
            if problem is None:
                try:
                    with store.open_output_stream(posixpath.join(staged, name)) as out:
                        out.write(text.encode("utf-8", "replace"))
                    names.add(name)
                    continue
                except OSError as e:
                    problem = str(e)
            errors.append({"out_name": name, "error": problem})
        if errors:
            with store.open_output_stream(posixpath.join(staged, ERRORS)) as out:
                out.write("".join(json.dumps(e) + "\n" for e in errors).encode())
        return Written(staged, place, len(names), len(errors))

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and (m.files or m.errors):
                store.move(m.staged, posixpath.join(root, m.place))
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """Removes what is left of this export's staging folders."""
        staging = posixpath.join(root, STAGING)
        if store.get_file_info(staging).type != fs.FileType.Directory:
            return
        for info in store.get_file_info(fs.FileSelector(staging)):
            if info.base_name.startswith(self.export):
                store.delete_dir(info.path)
        if not store.get_file_info(fs.FileSelector(staging)):
            store.delete_dir(staging)


class NamedFiles(DataSource):
    """Option ``path``; columns out_name and text, others are ignored."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        missing = {"out_name", "text"} - set(schema.names)
        if missing or overwrite:
            raise ValueError(f"columns needed: {sorted(missing)}" if missing else "named files are only appended")
        return NamedFilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """The rows of ``export_files`` (out_name, text, error) as named files; rows with an error are left out."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    with shuffles_cleared(spark), small_batches(spark):
        files.filter("error IS NULL").select("out_name", "text").write.format("named_files").mode("append").save(path)


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over: staging folders and lists of errors among them."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(store: fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """The files and the folders in ``folder`` that readers do not pass over."""
    infos = [i for i in store.get_file_info(fs.FileSelector(folder)) if not _hidden(i.base_name)]
    return [i.path for i in infos if i.type == fs.FileType.File], [i.path for i in infos if i.type == fs.FileType.Directory]


def _contents(path: str, folder: str, deep: bool) -> Iterator[pa.RecordBatch]:
    """Name and bytes of each file in ``folder`` (``deep``: and in the folders below it), in batches of about ``MOST_BYTES``."""
    store, _ = _store(path)
    folders = [folder]
    while folders:
        files, below = _listed(store, folders.pop())
        folders += below if deep else []
        names, contents, held = [], [], 0
        for file in files:
            with store.open_input_file(file) as f:
                content = f.read()
            if names and held + len(content) > MOST_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["out_name", "content"])
                names, contents, held = [], [], 0
            names.append(posixpath.basename(file))
            contents.append(content)
            held += len(content)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["out_name", "content"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """out_name, text of every file under ``path`` but the lists of errors."""
    share_package(spark)
    path = path.rstrip("/")
    store, root = _store(path)
    files, folders = _listed(store, root)
    # an RDD's size counts as unknown, so nobody broadcasts the texts for the few folders
    parts = [(root, False)] * bool(files) + [(f, True) for f in sorted(folders)]
    places = spark.createDataFrame(spark.sparkContext.parallelize(parts, max(1, len(parts))), "folder string, deep boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.to_pylist():
                yield from _contents(path, place["folder"], place["deep"])
    raw = places.mapInArrow(run, "out_name string, content binary")
    return raw.select("out_name", decode_utf8(F.col("content")).alias("text"))
