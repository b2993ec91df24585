"""File discovery, header checks and CSV reading with exact row positions."""

from __future__ import annotations

import csv
import fnmatch
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Headers opened at a time; each is one short read without a job.
HEADER_READERS = 32


class HeaderError(ValueError):
    """A file lacks columns its dataset must have."""


def list_files(spark: SparkSession, path: str, patterns: Sequence[str] = ("*.csv",), recursive: bool = True) -> list[str]:
    """Files under ``path`` (any Hadoop file system), by path; hidden names are skipped."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise FileNotFoundError(path)
    if system.getFileStatus(root).isFile():
        return [root.toString()]
    found, listing = [], system.listFiles(root, recursive)
    while listing.hasNext():
        at = listing.next().getPath()
        if not at.getName().startswith(".") and any(fnmatch.fnmatch(at.getName().lower(), p) for p in patterns):
            found.append(at.toString())
    if not found:
        raise FileNotFoundError(f"no {', '.join(patterns)} under {path}")
    return sorted(found)


def clean_names(names: Sequence[str]) -> list[str]:
    """Trims padding and byte order marks; a repeated name gets a numbered suffix."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names):
        name = raw.replace("﻿", "").replace("ï»¿", "").strip() or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(f"{name}.{count}" if count else name)
    return out


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    """First line of a (possibly compressed) file, read on the driver without a job."""
    jvm = spark._jvm
    at, conf = jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = at.getFileSystem(conf).open(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding))
    try:
        return reader.readLine()
    finally:
        reader.close()


def parse_header(line: str) -> list[str]:
    return clean_names(next(csv.reader([line])))


def require_columns(names: Sequence[str], required: Sequence[str], where: str) -> None:
    """Fails loudly on a foreign file; an empty result would pass for an empty dataset."""
    missing = [c for c in required if c not in names]
    if missing:
        raise HeaderError(f"{where} lacks required column(s) {missing}; it has {len(names)} starting {list(names)[:5]}")


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _file_columns(df: DataFrame) -> DataFrame:
    at = F.col("_metadata.file_path")
    return df.select(
        "*", at.alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))


def with_positions(df: DataFrame) -> DataFrame:
    """Adds ``position``, the 0-based data row number in the file.

    Rows of one file block are consecutive in their scan task, so a block needs only its row count and its
    first row number; the rows themselves are not shuffled.
    """
    blocks = df.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = df.join(offsets, ["file", "_block"])
    return joined.withColumn("position", F.col("_offset") + F.col("_row") - F.col("_first")).drop(
        "_offset", "_first", "_row", "_block")


def read_csv(
    spark: SparkSession,
    files: Sequence[str],
    required: Sequence[str] = (),
    names: Sequence[str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Every column as text plus ``file``, ``file_rank`` and ``position``.

    Headers are checked file by file; files with the same header share one scan. ``names`` is for files
    without a header. The header decides the columns, never the values.
    """
    groups: dict[tuple, list[str]] = {}
    lines: Sequence[str | None] = [None] * len(files)
    if names is None:
        with ThreadPoolExecutor(HEADER_READERS) as readers:
            lines = list(readers.map(lambda p: first_line(spark, p, encoding), files))
    for path, line in zip(files, lines, strict=True):
        if names is not None:
            header = tuple(names)
        else:
            if line is None:
                continue
            header = tuple(parse_header(line))
            require_columns(header, required, path)
        groups.setdefault(header, []).append(path)
    if not groups:
        raise HeaderError(f"all of {list(files)[:5]} are empty")
    scans = []
    for header, paths in groups.items():
        reader = spark.read.schema(string_schema(header)).option("encoding", encoding).option("enforceSchema", True)
        scans.append(_file_columns(reader.csv(paths, header=names is None)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [with_positions(s) for s in scans])
    return with_ranks(union, files)


def with_ranks(rows: DataFrame, files: Sequence[str]) -> DataFrame:
    """Adds ``file_rank``, the discovery order of ``file``; a join on the whole path, so the plan has no list of files."""
    plain = [(re.sub(r"^(\w+):/+", r"\1:/", p if ":" in p.split("/")[0] else f"file:{p}"), i) for i, p in enumerate(files)]
    ranks = rows.sparkSession.createDataFrame(plain, "_path string, file_rank int")
    decoded = F.url_decode(F.regexp_replace(F.col("file"), r"\+", "%2B"))
    return rows.join(ranks, F.regexp_replace(decoded, r"^(\w+):/+", "$1:/") == F.col("_path"), "left").drop("_path")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/"), -1)


def folder_name(path: Column) -> Column:
    return F.element_at(F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/"), -2)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def utf8_or_latin(text: Column) -> Column:
    """Text read as latin-1 whose bytes may be UTF-8: decoded as UTF-8 where that is valid."""
    return F.coalesce(F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")), text)


def parse_time(rows: DataFrame, column: str, pattern: str, name: str = "ts") -> DataFrame:
    """Strict format; general parsing only for a file in which the format matched nothing."""
    strict = F.try_to_timestamp(F.col(column), F.lit(pattern))
    loose = F.col(column).try_cast("timestamp")
    ok = rows.groupBy("file").agg(F.bool_or(strict.isNotNull()).alias("_strict"))
    return rows.join(ok, "file").withColumn(name, F.when(F.col("_strict"), strict).otherwise(loose)).drop("_strict")
