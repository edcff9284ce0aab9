"""Records of the members of zip archives, inflated in chunks: neither archive nor member is unpacked or held whole."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terravane.sources.blocks import located

#: Bytes of a member that are inflated at once; bytes of records that are sent on together.
CHUNK, SENT = 1 << 20, 4 << 20


def parts(chunks: Iterator[bytes], end: bytes) -> Iterator[bytes]:
    """What lies between ends, wherever the chunks' edges fall, an end across an edge too; what follows the last end comes last."""
    carry = b""
    for chunk in chunks:
        # An end may have begun in the carry's last bytes, not before.
        *whole, carry = (carry + chunk).split(end) if end in carry[-len(end) :] + chunk else (carry + chunk,)
        yield from whole
    yield carry


@dataclass
class _Member(InputPartition):
    path: str
    member: str


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.end, self.suffix = options["path"], options["end"].encode(), options.get("member", "")
        self.wanted, self.chunk = [w.encode() for w in json.loads(options.get("any", "[]"))], int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        archives = [info] if info.type == files.FileType.File else [f for f in system.get_file_info(files.FileSelector(path)) if f.path.endswith(".zip")]
        out = []
        for archive in sorted(archives, key=lambda f: f.path):
            with system.open_input_file(archive.path) as source, zipfile.ZipFile(source) as z:
                out += [_Member(archive.path, m.filename) for m in z.infolist() if not m.is_dir() and m.filename.endswith(self.suffix)]
        return out or [_Member("", "")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = located(self.path)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.member] * n), pa.array([k for k, _ in held], pa.int64()), pa.array([r.decode("utf-8", "replace") for _, r in held], pa.string())], ["archive", "member", "number", "value"])

        with system.open_input_file(partition.path) as source, zipfile.ZipFile(source) as z, z.open(partition.member) as f:
            for k, record in enumerate(parts(iter(lambda: f.read(self.chunk), b""), self.end)):
                # By bytes, before anything is decoded.
                if record and (not self.wanted or any(w in record for w in self.wanted)):
                    held.append((k, record))
                    size += len(record)
                    if size >= SENT:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class ZipRecords(DataSource):
    """Options path (an archive, or a folder of them), end (what ends a record), member (how the members' names end), any (texts of which a record holds one, as JSON), chunk."""

    @classmethod
    def name(cls) -> str:
        return "zip_records"

    def schema(self) -> str:
        return "archive string, member string, number long, value string"

    def reader(self, schema) -> _ZipReader:
        return _ZipReader(self.options)


def zip_records(spark: SparkSession, path: str, end: str, member: str = "", any_of: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """(archive, member, number, value): the records of the members of zip archives, those that hold one of the texts if any are given.

    A member is one task, as deflated data has no place to begin in the middle; members of any size go through in chunks. number counts
    all records of a member from 0. Empty records are left out.
    """
    spark.dataSource.register(ZipRecords)
    return spark.read.format("zip_records").options(path=path, end=end, member=member, any=json.dumps(list(any_of)), chunk=str(chunk)).load()
