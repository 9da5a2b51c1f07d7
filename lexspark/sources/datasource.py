"""``spark.read.format("fsa")`` and ``df.write.format("fsa")``: sequences of binary automata as a data source.

Read options: ``path`` (a file, or a folder whose files are all read) and ``expectVersion``; each file is one partition.
Write options: ``path`` (a folder), ``version`` and ``numbers``; each task writes an automaton of its own sequences, so
``repartitionByRange`` keeps them apart and ``coalesce(1)`` makes a single one. A task that fails leaves no file. A path
without a scheme is one of the machine; on a cluster it must be a mounted folder that all share, which a write checks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import formats


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FsaReader(DataSourceReader):
    def __init__(self, path: str, expect: int | None) -> None:
        self.path, self.expect = path, expect

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _open(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            return [InputPartition(f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
        return [InputPartition(path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _open(self.path)[0].open_input_file(partition.value) as f:
            automaton = formats.read(f.read(), self.expect)
        part: list[bytes] = []
        for s in automaton.sequences():
            part.append(s)
            if len(part) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["seq"])
                part = []
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["seq"])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class FsaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str, numbers: bool, overwrite: bool) -> None:
        self.path, self.version, self.numbers, self.overwrite = path.rstrip("/"), version, numbers, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        seqs = sorted({s.encode() if isinstance(s, str) else bytes(s) for b in batches for s in b.column(0).to_pylist() if s})
        name = uuid.uuid4().hex
        out = Written(f"{self.path}/_{name}", f"{self.path}/part-{name}.{self.version}")
        if seqs:
            system, folder = _open(self.path)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(_open(out.temporary)[1]) as f:
                f.write(formats.WRITERS[self.version](seqs, numbers=self.numbers))
        else:
            out.temporary = ""
        return out

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None and m.temporary]
        if lost := [m for m in done if system.get_file_info(_open(m.temporary)[1]).type == fs.FileType.NotFound]:
            raise ValueError(f"{len(lost)} of {len(done)} files that tasks have written aren't in {self.path}: name a folder that driver and executors share, by its URI")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.is_file and f.base_name.startswith("part-"):
                    system.delete_file(f.path)
        for m in done:
            system.move(_open(m.temporary)[1], _open(m.final)[1])

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.temporary:
                system, path = _open(m.temporary)
                system.delete_file(path)


class FsaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fsa"

    def schema(self) -> str:
        return "seq binary"

    def reader(self, schema) -> FsaReader:
        expect = self.options.get("expectVersion")
        return FsaReader(self.options["path"], int(expect, 0) if expect else None)

    def writer(self, schema, overwrite: bool) -> FsaWriter:
        version = self.options.get("version", "fsa5").lower()
        if version not in formats.WRITERS:
            raise ValueError(f"version: {version!r} is none of {', '.join(formats.WRITERS)}")
        if [f.dataType.simpleString() for f in schema] not in (["binary"], ["string"]):
            raise ValueError("an automaton is written from one column of bytes")
        return FsaWriter(self.options["path"], version, self.options.get("numbers", "false").lower() == "true", overwrite)
