"""Classic packet captures as a Spark data source: one task per capture, packets and drops as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowlens.functions import labels
from flowlens.operators.flows import assemble_flows, flow_rows
from flowlens.schemas import PACKET
from flowlens.sources.archives import open_binary
from flowlens.sources.files import list_files

# Fixed values of the capture format.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
NEXT_GENERATION = b"\x0a\x0d\x0d\x0a"
NULL, ETHERNET, RAW, COOKED = 0, 1, 101, 113
IPV4, VLAN, IPV6 = 0x0800, 0x8100, 0x86DD
TRANSPORT = {6: "tcp", 17: "udp", 1: "icmp"}
BATCH = 20_000
FIELDS = ("capture", "family", "seq", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "drop_reason")
ARROW = pa.schema([
    ("capture", pa.string()), ("family", pa.string()), ("seq", pa.int64()), ("ts_us", pa.int64()), ("src_ip", pa.string()),
    ("dst_ip", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("protocol", pa.string()),
    ("length", pa.int32()), ("drop_reason", pa.string())])


class CaptureError(ValueError):
    """Not a classic capture file."""


def network_layer(frame: bytes, link: int) -> tuple[bytes | None, str]:
    """The IPv4 datagram of a frame, or the reason there is none."""
    if link == ETHERNET:
        kind = int.from_bytes(frame[12:14], "big") if len(frame) >= 14 else -1
        inner, at = kind, 14
        if kind == VLAN:
            inner, at = (int.from_bytes(frame[16:18], "big"), 18) if len(frame) >= 18 else (-1, 18)
        if inner == IPV4:
            return frame[at:], ""
        return None, "ipv6_frames" if kind == IPV6 else "unusable_frames" if kind == IPV4 else "non_ip_frames"
    if link == COOKED:
        good, at = len(frame) >= 16 and int.from_bytes(frame[14:16], "big") == IPV4, 16
    elif link == RAW:
        good, at = bool(frame) and frame[0] >> 4 == 4, 0
    else:
        good, at = len(frame) >= 4 and int.from_bytes(frame[:4], "little") == 2, 4
    return (frame[at:], "") if good else (None, "non_ip_frames")


def five_tuple(data: bytes) -> tuple | None:
    """(source, destination, source port, destination port, protocol, captured length)."""
    if len(data) < 20 or data[0] >> 4 != 4:
        return None
    head = (data[0] & 15) * 4
    if head < 20 or len(data) < head or int.from_bytes(data[6:8], "big") & 0x1FFF:
        return None
    claimed = int.from_bytes(data[2:4], "big")
    ports = (None, None)
    if data[9] in (6, 17) and len(data) >= head + 4:
        ports = struct.unpack_from(">HH", data, head)
    dotted = lambda at: "%d.%d.%d.%d" % tuple(data[at:at + 4])
    return (dotted(12), dotted(16), *ports, TRANSPORT.get(data[9], "other"), min(claimed, len(data)) if claimed else len(data))


class CapturePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]) -> None:
        self.paths = paths

    def partitions(self):
        return [CapturePartition(p) for p in self.paths]

    def rows(self, path: str) -> Iterator[tuple]:
        parts = path.rstrip("/").split("/")
        name = parts[-1]
        family = parts[-2] if len(parts) > 1 and parts[-2] not in ("", ".") else name.rsplit(".", 1)[0]
        drop = lambda seq, ts, why: (path, family, seq, ts, *[None] * 6, why)
        with open_binary(path) as handle:
            header = handle.read(24)
            if len(header) < 24:
                raise CaptureError(f"{name}: shorter than a capture header")
            if header[:4] not in MAGIC:
                kind = "the next-generation container" if header[:4] == NEXT_GENERATION else "no capture"
                raise CaptureError(f"{name}: {kind} (magic {header[:4]!r})")
            order, per_us = MAGIC[header[:4]]
            (link,) = struct.unpack_from(order + "I", header, 20)
            if link not in (NULL, ETHERNET, RAW, COOKED):
                yield drop(0, None, f"linktype_{link}")
                return
            record, seq = struct.Struct(order + "IIII"), 0
            while len(head := handle.read(16)) == 16:
                seconds, fraction, size, _ = record.unpack(head)
                frame = handle.read(size)
                ts = seconds * 1_000_000 + fraction // per_us
                if len(frame) < size:
                    yield drop(seq, ts, "truncated_final_record")
                    return
                data, why = network_layer(frame, link)
                found = five_tuple(data) if data is not None else None
                if found is None:
                    yield drop(seq, ts, why or "fragments_and_malformed")
                else:
                    yield (path, family, seq, ts, *found, None)
                seq += 1

    def read(self, partition: CapturePartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(partition.path):
            held.append(row)
            if len(held) == BATCH:
                yield self.batch(held)
                held = []
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class Captures(DataSource):
    """``spark.read.format("captures").option("paths", "a.pcap\\nb.pcap")``."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self):
        return PACKET

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options["paths"].split("\n"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packets and drop rows (``drop_reason`` set) of every capture under ``path``."""
    spark.dataSource.register(Captures)
    found = list_files(spark, path, ("*.pcap", "*.cap", "*.pcapng"))
    return spark.read.format("captures").option("paths", "\n".join(p.removeprefix("file:") for p in found)).load()


def capture_flows(packets: DataFrame, **timeouts) -> DataFrame:
    """Flow rows of the captures whose family is known; ``source_ip`` sent the first packet."""
    good = packets.filter(F.col("drop_reason").isNull())
    known = good.withColumn("category", labels.category_capture(F.col("family"))).filter(F.col("category").isNotNull())
    flows = assemble_flows(known, ["capture", "family"], **timeouts)
    category = labels.category_capture(F.col("family"))
    return flow_rows(flows, category, labels.verdict_label(category), F.col("family"))


def capture_report(packets: DataFrame) -> DataFrame:
    """Per capture and reason: packets used, packets dropped, and whether the family is in scope."""
    reason = F.coalesce("drop_reason", F.when(labels.category_capture(F.col("family")).isNull(), F.lit("family_out_of_scope")),
                        F.lit("packets"))
    return packets.groupBy("capture", "family", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
