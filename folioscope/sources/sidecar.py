"""Vector sidecars: one binary file of quantised vectors per document, as a Spark data source.

Register it with ``spark.dataSource.register(SidecarSource)``. Rows are read file
by file, files dealt to tasks by their bytes. A damaged file gives one row with
``problem`` and no section, so a scan goes on past it. Rows are written one file a
document; tasks write into a staging folder, and a commit moves the files to
their places, which every reader sees whole or not at all. An aborted write leaves nothing.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format: magic, header (magic, version, reserved, sections, dimension, scale), bytes of the space's digest, ends of names and numbers.
MAGIC, HEADER, SPACE_BYTES, MOST_SECTIONS, MOST_ID = b"LSPE", "<4sBBHIf", 16, 65535, 255
#: A file without a space's identity is of the first version, one with it of the second.
VERSIONS, SUFFIX = (1, 2), ".bin"
SCHEMA = "slug string, place int, section_id string, vector array<tinyint>, scale float, dim int, version int, space_id string, problem string"
#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20


def decoded(data: bytes) -> tuple[dict, list[tuple[str, bytes]]]:
    """Header and sections (id, vector) of a file; ``ValueError`` names what is wrong with it."""
    size = struct.calcsize(HEADER)
    if len(data) < size:
        raise ValueError("too_short")
    magic, version, _, count, dim, scale = struct.unpack(HEADER, data[:size])
    if magic != MAGIC:
        raise ValueError("bad_magic")
    if version not in VERSIONS:
        raise ValueError("unsupported_version")
    at, space = size, None
    if version == 2:
        at += SPACE_BYTES
        if len(data) < at:
            raise ValueError("truncated_header")
        space = data[size:at].hex()
    sections = []
    for _ in range(count):
        if at >= len(data):
            raise ValueError("truncated_body")
        end = at + 1 + data[at]
        if end > len(data):
            raise ValueError("truncated_id")
        try:
            name = data[at + 1 : end].decode("utf-8")
        except UnicodeDecodeError:
            raise ValueError("invalid_id") from None
        at = end + dim
        if at > len(data):
            raise ValueError("truncated_vector")
        sections.append((name, data[end:at]))
    if at != len(data):
        raise ValueError("trailing_bytes")
    return {"scale": scale, "dim": dim, "version": version, "space_id": space}, sections


def encoded(sections: list[tuple[str, bytes]], scale: float, dim: int, space: str | None = None) -> bytes:
    """The file of a document's sections; the same input gives the same bytes."""
    if len(sections) > MOST_SECTIONS:
        raise ValueError(f"{len(sections)} sections; at most {MOST_SECTIONS}")
    digest = bytes.fromhex(space) if space is not None else b""
    if space is not None and len(digest) != SPACE_BYTES:
        raise ValueError(f"a space's identity has {2 * SPACE_BYTES} hexadecimal digits, not {space!r}")
    parts = [struct.pack(HEADER, MAGIC, 1 if space is None else 2, 0, len(sections), dim, scale), digest]
    for name, vector in sections:
        held = name.encode("utf-8")
        if not 1 <= len(held) <= MOST_ID:
            raise ValueError(f"a section id has 1 to {MOST_ID} bytes, not {len(held)}")
        if len(vector) != dim:
            raise ValueError(f"a vector of {len(vector)} entries among those of {dim}")
        parts += [bytes([len(held)]), held, vector]
    return b"".join(parts)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SidecarSource(DataSource):
    """Format ``sidecar``: ``load(folder)`` and ``save(folder)``; mode ``overwrite`` replaces all files of the folder."""

    @classmethod
    def name(cls) -> str:
        return "sidecar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SidecarReader:
        return SidecarReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> SidecarWriter:
        return SidecarWriter(self.options["path"], overwrite)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX)), key=lambda f: f.path)


class SidecarReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held, size = [], 0
        for info in _listed(*_place(self.path)):
            if held and size + info.size > self.task_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _place(self.path)
        for path in partition.paths:
            slug = path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
            with files.open_input_stream(path) as stream:
                data = stream.read()
            try:
                head, sections = decoded(data)
            except ValueError as why:
                yield (slug, None, None, None, None, None, None, None, str(why))
                continue
            for place, (name, vector) in enumerate(sections):
                yield (slug, place, name, memoryview(vector).cast("b").tolist(), head["scale"], head["dim"], head["version"], head["space_id"], None)


class SidecarWriter(DataSourceWriter):
    """Takes rows with slug, place, section_id, vector, scale, dim and space_id, those of a document together and in order, as ``prepared`` deals them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, folder = _place(self.path)
        files.create_dir(f"{folder}/{self.staging}")
        made = []
        for slug, rows in groupby(iterator, key=lambda r: r["slug"]):
            held = sorted(rows, key=lambda r: r["place"])
            heads = {(r["scale"], r["dim"], r["space_id"]) for r in held}
            if len(heads) > 1:
                raise ValueError(f"{slug}: one file has one scale, dimension and space")
            ((scale, dim, space),) = heads
            data = encoded([(r["section_id"], struct.pack(f"{len(r['vector'])}b", *r["vector"])) for r in held], scale, dim, space)
            name = f"{self.staging}/{uuid.uuid4().hex}-{slug}{SUFFIX}"  # an attempt that is run again has a name of its own
            with files.open_output_stream(f"{folder}/{name}") as stream:
                stream.write(data)
            made.append(name)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        made = [name for m in messages if m for name in m.files]
        slugs = [name.split("/")[-1].split("-", 1)[1] for name in made]
        if len(set(slugs)) < len(slugs):
            self.abort(messages)
            raise ValueError("a document came in several tasks; deal rows with sidecar.prepared")
        if self.overwrite:
            for info in _listed(files, folder):
                if info.path.rsplit("/", 1)[-1] not in set(slugs):
                    files.delete_file(info.path)
        for name, slug in zip(made, slugs):
            files.move(f"{folder}/{name}", f"{folder}/{slug}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        if files.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.staging}")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows as the writer takes them: those of a document in one task, together."""
    told = rows.select(
        F.col("slug").cast("string"), F.col("place").cast("int"), F.col("section_id").cast("string"), F.col("vector").cast("array<tinyint>"), F.col("scale").cast("float"),
        F.size("vector").alias("dim"), F.lit(None).cast("int").alias("version"), F.col("space_id").cast("string"), F.lit(None).cast("string").alias("problem"),
    )
    return told.repartition("slug").sortWithinPartitions("slug", "place")


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write a file for every slug of rows (slug, place, section_id, vector, scale, space_id)."""
    rows.sparkSession.dataSource.register(SidecarSource)
    prepared(rows).write.format("sidecar").mode(mode).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(SidecarSource)
    return spark.read.format("sidecar").options(**options).load(path)
