"""One document out of many ordered pieces, written by all tasks and gathered by none.

A piece is a line of text; pieces in order are the document.  Each task writes its range of the
order to a part of its own and reports how the part begins and ends.  The commit strings the
parts together, a buffer at a time, puts a comma where one list element follows another across a
border, and renames the result, so the document is there as a whole or not at all.  No task and
no list ever holds more than a batch of pieces.

Paths are whatever pyarrow's file systems open: local and mounted folders, HDFS, object stores.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Ship the writer with its tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUFFER = 8 << 20
PIECE = "text string, starts boolean, ends boolean"


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: its place in the order, its file, and whether an element begins and ends it."""

    place: int
    file: str
    starts: bool
    ends: bool
    size: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.aside = f"{path}.{uuid.uuid4().hex}"

    def _store(self) -> tuple[pa.fs.FileSystem, str, str]:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        return store, path, path + self.aside[len(self.path):]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, _, aside = self._store()
        context = TaskContext.get()
        place, file = context.partitionId(), f"{aside}.parts/{context.partitionId():08}-{context.taskAttemptId()}"
        store.create_dir(f"{aside}.parts", recursive=True)
        first, ends, size = None, False, 0
        with store.open_output_stream(file) as out:
            for batch in iterator:
                for text, starts, closes in zip(*(c.to_pylist() for c in batch.columns)):
                    line = ("," if ends and starts else "") + text + "\n"
                    size += out.write(line.encode())
                    first = starts if first is None else first
                    ends = closes
        return Part(place, file, bool(first), ends, size)

    def commit(self, messages: list[Part | None]) -> None:
        store, path, aside = self._store()
        ends = False
        with store.open_output_stream(aside) as out:
            for part in sorted((m for m in messages if m is not None and m.size), key=lambda m: m.place):
                if ends and part.starts:
                    out.write(b",")
                with store.open_input_stream(part.file) as text:
                    while block := text.read(BUFFER):
                        out.write(block)
                ends = part.ends
        if store.get_file_info(path).type == pa.fs.FileType.File and not isinstance(store, pa.fs.LocalFileSystem):
            store.delete_file(path)  # only a local rename replaces its target
        store.move(aside, path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _, aside = self._store()
        if store.get_file_info(f"{aside}.parts").type == pa.fs.FileType.Directory:
            store.delete_dir(f"{aside}.parts")


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_document(pieces: DataFrame, path: str, order: list[str]) -> None:
    """Write ``pieces`` (text, starts, ends and the columns of ``order``) as one file, replacing it.

    A piece that ``starts`` an element and follows one that ``ends`` one gets a comma in front.
    Texts hold no line breaks, as JSON of Spark's doesn't; each is a line of the document, so a
    document of any size can be read back in splits.
    """
    pieces.sparkSession.dataSource.register(DocumentSource)
    (pieces.orderBy(*order).select("text", "starts", "ends").write.format("ordered_document")
     .mode("overwrite").option("path", path).save())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of a document without the commas, in any order: (text)."""
    return spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("text"))


def piece(text: Column | str, starts: bool = False, ends: bool = False) -> list[Column]:
    """The three columns of a piece; a fixed text can be given as it is."""
    return [(F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends")]


def element(text: Column) -> list[Column]:
    """A piece that is a whole element of a list or object."""
    return piece(text, True, True)


def fixed(spark: SparkSession, texts: dict[int, str]) -> DataFrame:
    """Pieces between sections: (place, text, starts, ends) by their place."""
    return spark.createDataFrame([(k, t, False, False) for k, t in texts.items()], f"place int, {PIECE}")
