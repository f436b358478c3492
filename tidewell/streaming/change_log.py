"""A change log as a data source that streams, with acknowledgements by consumer.

A log is a folder of numbered segments, each a folder of Parquet files that is put in place by one rename and never changed: a number is
either whole or not there. ``spark.readStream.format("tidewell_changes")`` reads it; an offset is the number of the last segment read,
so a restart from a checkpoint reads the same segments for the same batch. When a batch is done, Spark's commit writes the offset down as the
consumer's acknowledgement; a stream without a checkpoint begins behind it. Tasks read files; the driver lists segments and nothing
else, and there is no table of changes in it.

Options: path; consumer (name of the acknowledgement, none: nothing is acknowledged); segments (most segments a batch, 0: all there are;
under ``availableNow`` Spark asks for one batch, so a bound there leaves the rest to the next run). Folders are URIs of any file
system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.content import TRACKER
from ..sources.static_writer import open_folder
from .incremental import _files as hadoop_path
from .incremental import latest_actions

COLUMNS = [c.split(" ")[0] for c in TRACKER.split(", ")]


def _numbers(folder: str) -> list[int]:
    """Numbers of the segments that are there, in order."""
    from pyarrow.fs import FileSelector

    fs, root = open_folder(folder)
    return sorted(int(x.base_name) for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.base_name.isdigit())


def _acknowledged(folder: str, consumer: str) -> int:
    from pyarrow.fs import FileType

    fs, root = open_folder(folder)
    path = f"{root}/_acknowledged/{consumer}"
    if not consumer or fs.get_file_info(path).type == FileType.NotFound:
        return 0
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())["segment"]


def _acknowledge(folder: str, consumer: str, segment: int) -> None:
    """Offsets only grow: a batch that is committed again takes nothing back."""
    if not consumer or segment <= _acknowledged(folder, consumer):
        return
    fs, root = open_folder(folder)
    fs.create_dir(f"{root}/_acknowledged", recursive=True)
    own = f"{root}/_acknowledged/.{consumer}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(json.dumps({"segment": segment}).encode())
    fs.move(own, f"{root}/_acknowledged/{consumer}")


@dataclass
class ChangeLog:
    """A log for writers and for batch readers."""

    spark: SparkSession
    folder: str

    def append(self, changes: DataFrame) -> int:
        """Add a segment of (content_id, content_type, action, changed_at); its number. Writers at the same time get different ones."""
        fs, own = hadoop_path(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        changes.select(*COLUMNS).write.parquet(own.toString())
        number = max([0, *_numbers(self.folder)])
        while True:
            number += 1
            target = hadoop_path(self.spark, f"{self.folder}/{number:012d}")[1]
            # a rename onto a folder that is there would move into it, so the name is taken first
            if fs.createNewFile(hadoop_path(self.spark, f"{self.folder}/_taken/{number:012d}")[1]):
                break
        if not fs.rename(own, target):
            raise RuntimeError(f"segment {number} of {self.folder} couldn't be put in place")
        return number

    def _read(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], TRACKER)
        return self.spark.read.schema(TRACKER).parquet(*[f"{self.folder}/{n:012d}" for n in numbers])

    def pending(self, consumer: str) -> tuple[DataFrame, int]:
        """Changes that a consumer hasn't acknowledged, and the number to acknowledge for them."""
        since = _acknowledged(self.folder, consumer)
        numbers = [n for n in _whole(self.folder) if n > since]
        return self._read(numbers), numbers[-1] if numbers else since

    def latest(self, consumer: str) -> DataFrame:
        """The last pending action of each id."""
        return latest_actions(self.pending(consumer)[0])

    def acknowledge(self, consumer: str, segment: int) -> None:
        _acknowledge(self.folder, consumer, segment)

    def trim(self, consumers: list[str]) -> int:
        """Remove the segments that all of these consumers have acknowledged, but for the last, which keeps the count."""
        least = min((_acknowledged(self.folder, c) for c in consumers), default=0)
        numbers = _whole(self.folder)
        gone = [n for n in numbers if n <= least and n != numbers[-1]]
        for n in gone:
            fs, path = hadoop_path(self.spark, f"{self.folder}/{n:012d}")
            fs.delete(path, True)
        return len(gone)

    def stream(self, consumer: str = "", segments: int = 0) -> DataFrame:
        self.spark.dataSource.register(ChangeSource)
        return self.spark.readStream.format("tidewell_changes").option("path", self.folder).option("consumer", consumer).option("segments", str(segments)).load()


def _whole(folder: str) -> list[int]:
    """Segments up to the first number that a writer has taken but not yet filled: later ones wait for it, so no offset passes it by.

    A writer that was lost leaves a number that is never filled; ``give_up`` frees those who wait.
    """
    from pyarrow.fs import FileSelector

    fs, root = open_folder(folder)
    taken = {int(x.base_name) for x in fs.get_file_info(FileSelector(f"{root}/_taken", allow_not_found=True)) if x.base_name.isdigit()}
    there = _numbers(folder)
    open_ = taken - set(there)
    first = there[0] if there else 0
    stop = min((n for n in open_ if n > first), default=None)
    return [n for n in there if stop is None or n < stop]


def give_up(folder: str, number: int) -> None:
    """Declare a taken number empty, since its writer was lost."""
    fs, root = open_folder(folder)
    fs.delete_file(f"{root}/_taken/{number:012d}")


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewell_changes"

    def schema(self) -> str:
        return TRACKER

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options["path"].rstrip("/"), self.options.get("consumer", ""), int(self.options.get("segments", "0")))


class ChangeReader(DataSourceStreamReader):
    def __init__(self, folder: str, consumer: str, most: int):
        self.folder, self.consumer, self.most = folder, consumer, most
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"segment": _acknowledged(self.folder, self.consumer)}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = _acknowledged(self.folder, self.consumer)
        ahead = [n for n in _whole(self.folder) if n > self.at]
        if ahead:
            self.at = ahead[min(self.most, len(ahead)) - 1] if self.most else ahead[-1]
        return {"segment": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        self.at = max(self.at or 0, end["segment"])  # after a restart, go on from the checkpoint
        fs, root = open_folder(self.folder)
        out = []
        for n in _numbers(self.folder):
            if start["segment"] < n <= end["segment"]:
                out += [InputPartition(x.path) for x in fs.get_file_info(FileSelector(f"{root}/{n:012d}")) if x.base_name.endswith(".parquet")]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = pa.schema([("content_id", pa.string()), ("content_type", pa.string()), ("action", pa.string()), ("changed_at", pa.timestamp("us", "UTC"))])
        fs, _ = open_folder(self.folder)
        with fs.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=COLUMNS):
                yield from pa.Table.from_batches([batch]).cast(kinds).to_batches()

    def commit(self, end: dict) -> None:
        _acknowledge(self.folder, self.consumer, end["segment"])
