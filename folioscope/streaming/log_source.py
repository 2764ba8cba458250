"""An append-only log as a stream with a cursor that proves what it has read.

An offset is a position in the file and the digest of all bytes before it. Where
the file no longer begins with the bytes that were read, because it was
rewritten or cut, and where a new line corrects an older one, the next batch is the whole log
and says so, and what was made of the earlier one is made anew.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = "position long, line string, rebuilt boolean"
#: Bytes that a task reads, and that are looked at at once.
TASK_BYTES, CHUNK = 32 << 20, 1 << 20


@dataclass
class Stretch(InputPartition):
    """The lines that begin in [low, high) of a log of ``end`` bytes."""

    low: int
    high: int
    end: int
    rebuilt: bool


class LogSource(DataSource):
    """Format ``appended_log``: ``path`` of a file of lines; with ``corrections``, a text that lines which correct others hold."""

    @classmethod
    def name(cls) -> str:
        return "appended_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], self.options.get("corrections"), int(self.options.get("taskBytes", TASK_BYTES)))


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, corrections: str | None, task_bytes: int):
        self.path, self.corrections, self.task_bytes = path, corrections, task_bytes

    def _open(self):
        files, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return files.open_input_file(path) if files.get_file_info(path).type == fs.FileType.File else None

    def _digest(self, end: int) -> str | None:
        """Of the first ``end`` bytes; None where there are not so many."""
        digest, file = hashlib.sha256(), self._open()
        if file is None:
            return digest.hexdigest() if not end else None
        with file:
            if file.size() < end:
                return None
            while file.tell() < end:
                digest.update(file.read(min(CHUNK, end - file.tell())))
        return digest.hexdigest()

    def initialOffset(self) -> dict:
        return {"position": 0, "prefix": hashlib.sha256().hexdigest()}

    def latestOffset(self) -> dict:
        """Past the last whole line: one that is still being written is left for later."""
        file, end = self._open(), 0
        if file is not None:
            with file:
                low = file.size()
                while low and not end:
                    high, low = low, max(0, low - CHUNK)
                    file.seek(low)
                    at = file.read(high - low).rfind(b"\n")
                    end = low + at + 1 if at >= 0 else 0
        return {"position": end, "prefix": self._digest(end)}

    def _corrects(self, low: int, high: int) -> bool:
        needle, before = self.corrections.encode(), b""
        with self._open() as file:
            file.seek(low)
            while file.tell() < high:
                held = before + file.read(min(CHUNK, high - file.tell()))
                if needle in held:
                    return True
                before = held[-len(needle) + 1 :] if len(needle) > 1 else b""
        return False

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        low, high = start["position"], end["position"]
        rebuilt = low > 0 and (low > high or self._digest(low) != start["prefix"] or bool(self.corrections and self._corrects(low, high)))
        low = 0 if rebuilt else low
        cuts = [*range(low, high, self.task_bytes), high]
        # a rebuilt log that is empty still says that it is
        return [Stretch(a, b, high, rebuilt) for a, b in zip(cuts, cuts[1:])] or [Stretch(low, low, low, rebuilt)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.rebuilt and partition.low == 0:
            yield (-1, None, True)  # a mark, so that a batch without lines is told from one that is not there
        if partition.low >= partition.high:
            return
        with io.BufferedReader(self._open(), CHUNK) as file:
            file.seek(max(0, partition.low - 1))
            if partition.low and file.read(1) != b"\n":
                file.readline()  # belongs to the stretch before
            while file.tell() < partition.high:
                at = file.tell()
                line = file.readline()
                yield (at, line.rstrip(b"\n").decode("utf-8", "replace"), partition.rebuilt)

    def commit(self, end: dict) -> None:
        pass


def followed(spark: SparkSession, path: str, corrections: str | None = None, **options: str) -> DataFrame:
    """The lines of the log as a stream: position, line, and whether the batch is the whole log again (its mark has position -1 and no line)."""
    spark.dataSource.register(LogSource)
    stream = spark.readStream.format("appended_log").option("path", path).options(**options)
    return (stream.option("corrections", corrections) if corrections else stream).load()


def write_folded(stream: DataFrame, fold, merge, path: str, checkpoint: str) -> StreamingQuery:
    """Keep ``fold`` of all lines so far: ``fold`` makes rows of lines, ``merge`` one set of rows of two.

    Every batch writes its own version, made of the one before and of its lines, or of its lines
    alone where it is the whole log; a batch that is run again writes the same.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rebuilt = not batch.where("rebuilt").isEmpty()
            made = fold(batch.where("position >= 0"))
            if not rebuilt and number:
                made = merge(read_folded(batch.sparkSession, path, number - 1), made)
            made.write.mode("overwrite").parquet(f"{path}/version={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_folded(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}")
