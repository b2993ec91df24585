"""CSV members of zip archives as a Spark data source, one task per member."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowlens.sources.files import parse_header, require_columns, string_schema

BATCH = 20_000
LINES = pa.schema([("file", pa.string()), ("position", pa.int64()), ("line", pa.string())])


def open_binary(path: str):
    """Seekable file on a local or any Arrow-supported file system."""
    from pyarrow import fs
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def csv_members(path: str) -> list[tuple[str, str]]:
    """(member, header line) of the CSVs in an archive, by name."""
    with open_binary(path) as handle, zipfile.ZipFile(handle) as archive:
        out = []
        for info in sorted(archive.infolist(), key=lambda i: i.filename):
            if info.filename.lower().endswith(".csv") and not info.is_dir():
                with archive.open(info) as member:
                    out.append((info.filename, member.readline().decode("utf-8", "replace").rstrip("\r\n")))
        return out


class MemberPartition(InputPartition):
    def __init__(self, path: str, member: str) -> None:
        self.path = path
        self.member = member


class MemberReader(DataSourceReader):
    def __init__(self, members: Sequence[tuple[str, str]]) -> None:
        self.members = members

    def partitions(self):
        return [MemberPartition(*m) for m in self.members]

    def read(self, partition: MemberPartition) -> Iterator[pa.RecordBatch]:
        name = f"{partition.path}!{partition.member}"
        with open_binary(partition.path) as handle, zipfile.ZipFile(handle) as archive:
            with archive.open(partition.member) as raw:
                text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
                next(text, None)
                lines, start = [], 0
                for line in text:
                    line = line.rstrip("\r\n")
                    if not line:
                        continue
                    lines.append(line)
                    if len(lines) == BATCH:
                        yield self.batch(name, start, lines)
                        start, lines = start + len(lines), []
                if lines:
                    yield self.batch(name, start, lines)

    @staticmethod
    def batch(name: str, start: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(lines)), pa.array(range(start, start + len(lines)), pa.int64()), pa.array(lines)], schema=LINES)


class ZipLines(DataSource):
    """``spark.read.format("zip_lines").option("members", "archive\\tmember\\n...")``."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "file string, position bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader([tuple(m.split("\t")) for m in self.options["members"].split("\n")])


def read_zip_csv(spark: SparkSession, archives: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Same shape as ``read_csv``: text columns, ``file``, ``file_rank``, ``position``. Lines are parsed in the JVM."""
    spark.dataSource.register(ZipLines)
    groups: dict[tuple, list[tuple[str, str]]] = {}
    ranks: dict[str, int] = {}
    for archive in archives:
        for member, line in csv_members(archive):
            header = tuple(parse_header(line))
            require_columns(header, required, f"{archive}!{member}")
            groups.setdefault(header, []).append((archive, member))
            ranks[f"{archive}!{member}"] = len(ranks)
    if not ranks:
        raise FileNotFoundError(f"no CSV member in {list(archives)}")
    scans = []
    for header, members in groups.items():
        lines = spark.read.format("zip_lines").option("members", "\n".join("\t".join(m) for m in members)).load()
        parsed = F.from_csv("line", string_schema([f"c{i}" for i in range(len(header))]).simpleString()[7:-1].replace(":", " "))
        scans.append(lines.select(parsed.alias("r"), "file", "position").select(
            *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(header)], "file", "position"))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    order = spark.createDataFrame(list(ranks.items()), "file string, file_rank int")
    return union.join(order, "file", "left").select(*union.columns, "file_rank")
