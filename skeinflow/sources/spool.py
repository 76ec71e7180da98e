"""A log of epochs as a data source: what a speech service gives comes in through it, what windows get goes out.

A spool is a folder of part files and of one manifest for each epoch, which names the epoch's files and becomes visible
in one move. Files that no manifest names, of tasks or runs that failed, don't count. A stream reads epochs by number
and gives each file to a task; a stream that writes makes its micro-batch an epoch of the same number, so a batch that is
run again after a loss finds its manifest and adds nothing. Paths are those of pyarrow's file systems.

    spool.register(spark)
    spark.readStream.format("spool").schema(...).load(path)
    rows.writeStream.format("spool").option("checkpointLocation", ...).start(path)"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .wire import EVENT_LOG

_PARTS, _EPOCHS = "parts", "epochs"


class Folder:
    """The files of a spool."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)

    def _epoch(self, number: int) -> str:
        return f"{self.root}/{_EPOCHS}/{number:012d}.json"

    def epochs(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{_EPOCHS}", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def named(self, number: int) -> list[str]:
        with self.files.open_input_stream(self._epoch(number)) as f:
            return json.loads(f.read())

    def write(self, batches: Iterator[pa.RecordBatch]) -> list[str]:
        """A part file of the rows; none for none."""
        name, out = f"{uuid.uuid4().hex}.parquet", None
        for b in batches:
            if out is None and b.num_rows:
                self.files.create_dir(f"{self.root}/{_PARTS}", recursive=True)
                out = pq.ParquetWriter(f"{self.root}/{_PARTS}/{name}", b.schema, filesystem=self.files)
            if b.num_rows:
                out.write_batch(b)
        if out is None:
            return []
        out.close()
        return [name]

    def add(self, number: int, names: list[str]) -> None:
        """Makes an epoch of these files; where it is there already the files are dropped."""
        if number in self.epochs():
            return self.drop(names)
        self.files.create_dir(f"{self.root}/{_EPOCHS}", recursive=True)
        hidden = f"{self.root}/{_EPOCHS}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as f:
            f.write(json.dumps(names).encode())
        self.files.move(hidden, self._epoch(number))

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.files.delete_file(f"{self.root}/{_PARTS}/{n}")

    def read(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(f"{self.root}/{_PARTS}/{name}") as f:
            for b in pq.ParquetFile(f).iter_batches():
                yield pa.Table.from_batches([b]).select(schema.names).cast(schema).combine_chunks().to_batches()[0]


class Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _names(messages: list[Written | None]) -> list[str]:
    return [n for m in messages if m is not None for n in m.names]


class _Read:
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return Folder(self.path).read(partition.name, to_arrow_schema(self.schema))


class SpoolReader(_Read, DataSourceReader):
    """All epochs that are there when the query is planned."""

    def partitions(self) -> list[Part]:
        folder = Folder(self.path)
        return [Part(n) for e in folder.epochs() for n in folder.named(e)]


class SpoolStreamReader(_Read, DataSourceStreamReader):
    """Offsets are numbers of epochs; a gap in them ends what can be read."""

    def initialOffset(self) -> dict:
        return {"epoch": 0}

    def latestOffset(self) -> dict:
        n = 0
        for e in Folder(self.path).epochs():
            if e != n:
                break
            n += 1
        return {"epoch": n}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        folder = Folder(self.path)
        return [Part(n) for e in range(start["epoch"], end["epoch"]) for n in folder.named(e)]

    def commit(self, end: dict) -> None:
        """Epochs stay: other streams read them too."""

    def stop(self) -> None:
        pass


class SpoolStreamWriter(DataSourceStreamArrowWriter):
    """A micro-batch is the epoch of its number."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Folder(self.path).write(iterator))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).add(batchId, _names(messages))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.path).drop(_names(messages))


class SpoolWriter(DataSourceArrowWriter):
    """Appends one epoch. One writer at a time, as a service has one connection."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Folder(self.path).write(iterator))

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        folder.add(max(folder.epochs(), default=-1) + 1, _names(messages))

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).drop(_names(messages))


class Spool(DataSource):
    """Option path: the folder. Without a schema rows are those of the event log."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return EVENT_LOG

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> SpoolStreamReader:
        return SpoolStreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> SpoolStreamWriter:
        return SpoolStreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, once."""
    try:
        spark.dataSource.register(Spool)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
