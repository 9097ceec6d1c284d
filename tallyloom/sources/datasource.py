"""Folders of packed sketches as a data source: ``spark.read.format("sketch")`` and ``df.write.format("sketch")``.

A folder has shards, Arrow files of keys and sketches, one for each task that wrote, and ``manifest.json``, which
lists the shards that count with what they hold.  A shard's name is its task attempt's own, and only the driver, once
all tasks have ended well, replaces the manifest in one step: a reader sees a write as a whole or not at all, and
what a failed attempt left is not listed.  Cells are checked as they are written, so a listed shard has sketches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from tallyloom.errors import SketchError
from tallyloom.profiles import KIND_NAMES
from tallyloom.sources import wire
from tallyloom.sources.folders import store_of

MANIFEST, COLUMN, VERSION = "manifest.json", "sketch", 1
#: Options of a read that choose shards by what they hold.
CHOICES = ("kind", "profile", "domain")


@dataclass
class Shard(WriterCommitMessage, InputPartition):
    """A file of the folder: its rows and bytes, and the kinds, profiles and domains of its sketches."""

    file: str = ""
    rows: int = 0
    bytes: int = 0
    holds: list[list[str]] = field(default_factory=list)

    @property
    def value(self) -> str:
        return self.file


def read_manifest(path: str) -> dict | None:
    store, folder = store_of(path)
    if store.get_file_info(f"{folder}/{MANIFEST}").type != pyarrow.fs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{MANIFEST}") as source:
        found = json.loads(source.read())
    if found.get("version") != VERSION:
        raise SketchError(f"a manifest of version {found.get('version')!r}")
    return found


class SketchReader(DataSourceReader):
    """A partition a shard; ``kind``, ``profile`` and ``domain`` leave out shards that hold none such."""

    def __init__(self, path: str, wanted: dict[str, str]) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[Shard]:
        shards = [Shard(**s) for s in read_manifest(self.path)["shards"]]
        at = [(CHOICES.index(c), v) for c, v in self.wanted.items()]
        chosen = [s for s in shards if s.rows and any(all(own[i] == v for i, v in at) for own in s.holds)]
        return chosen or [Shard()]

    def _is_wanted(self, cell: bytes) -> bool:
        spec = wire.specification(cell)
        return all({"kind": KIND_NAMES[type(spec)], "profile": spec.profile, "domain": spec.domain}[c] == v for c, v in self.wanted.items())

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = store_of(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as source:
            shard = pa.ipc.open_file(source)
            for k in range(shard.num_record_batches):
                batch = shard.get_batch(k)
                if self.wanted:
                    batch = batch.filter(pa.array([self._is_wanted(c) for c in batch.column(COLUMN).to_pylist()], pa.bool_()))
                yield batch


class SketchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        store, folder = store_of(self.path)
        shard, holds, writer, sink = Shard(file=f"shard-{uuid.uuid4().hex}.arrow"), set(), None, None
        for batch in iterator:
            for cell in batch.column(COLUMN).to_pylist():
                if cell is None:
                    raise SketchError("a row has no sketch")
                spec, _ = wire.decode_any(cell)
                holds.add((KIND_NAMES[type(spec)], spec.profile, spec.domain))
                shard.bytes += len(cell)
            if writer is None:
                sink = store.open_output_stream(f"{folder}/{shard.file}")
                writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(batch)
            shard.rows += batch.num_rows
        if writer is None:
            return Shard()
        writer.close()
        sink.close()
        shard.holds = sorted(map(list, holds))
        return shard

    def commit(self, messages: list[Shard | None]) -> None:
        store, folder = store_of(self.path)
        before = read_manifest(self.path)
        new = [asdict(m) for m in messages if m is not None and m.file]
        if before and not self.overwrite:
            if StructType.fromJson(before["schema"]).simpleString() != self.schema.simpleString():
                raise SketchError("the folder has other columns")
            new = before["shards"] + new
        text = json.dumps({"version": VERSION, "schema": self.schema.jsonValue(), "shards": new}, indent=1)
        name = f"{folder}/{MANIFEST}-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as sink:
            sink.write(text.encode())
        store.move(name, f"{folder}/{MANIFEST}")
        if before and self.overwrite:
            for shard in before["shards"]:
                store.delete_file(f"{folder}/{shard['file']}")

    def abort(self, messages: list[Shard | None]) -> None:
        store, folder = store_of(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{folder}/{m.file}")


class SketchSource(DataSource):
    """``sketch``: key columns and a binary column ``sketch``."""

    @classmethod
    def name(cls) -> str:
        return "sketch"

    @property
    def path(self) -> str:
        if "path" not in self.options:
            raise SketchError("a folder of sketches needs a path")
        return self.options["path"]

    def schema(self) -> StructType:
        found = read_manifest(self.path)
        if found is None:
            raise SketchError(f"no manifest in {self.path}")
        return StructType.fromJson(found["schema"])

    def reader(self, schema: StructType) -> SketchReader:
        return SketchReader(self.path, {c: self.options[c] for c in CHOICES if c in self.options})

    def writer(self, schema: StructType, overwrite: bool) -> SketchWriter:
        if COLUMN not in schema.names or not isinstance(schema[COLUMN].dataType, BinaryType):
            raise SketchError(f"a binary column {COLUMN!r} is needed")
        return SketchWriter(self.path, schema, overwrite)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(SketchSource)
