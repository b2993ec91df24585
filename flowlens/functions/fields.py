"""Field expressions: safe numbers, protocols, ports, reconstructed hosts, event projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.labels import lookup

# Protocol and service tables.
PROTOCOL_BY_NAME = {"tcp": "tcp", "udp": "udp", "icmp": "icmp"}
PROTOCOL_BY_NUMBER = {6: "tcp", 17: "udp", 1: "icmp"}
PROTOCOL_BY_PORT = {443: "tcp", 8443: "tcp", 80: "tcp", 8080: "tcp", 53: "udp", 5353: "udp"}
KDD_SERVICE_PORT = {
    "http": 80, "http_443": 443, "ftp": 21, "ftp_data": 20, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53,
    "domain_u": 53, "pop_3": 110, "imap4": 143, "sql_net": 1433, "ldap": 389, "netbios_ns": 137, "netbios_dgm": 138,
    "netbios_ssn": 139, "printer": 515, "nntp": 119, "exec": 512, "login": 513, "shell": 514, "whois": 43,
    "finger": 79, "gopher": 70, "irc": 194, "X11": 6000, "Z39_50": 210, "auth": 113,
}
NB15_SERVICE_PORT = {
    "dhcp": 67, "dns": 53, "ftp": 21, "ftp-data": 20, "http": 80, "irc": 194, "pop3": 110, "radius": 1812,
    "smtp": 25, "snmp": 161, "ssh": 22, "ssl": 443,
}
DNS_OVERHEAD_BYTES = 44  # 20 IPv4 + 8 UDP + 12 DNS + 4 question


def number_or_null(value: Column) -> Column:
    """Finite number or NULL."""
    d = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number_or_zero(value: Column) -> Column:
    return F.coalesce(number_or_null(value), F.lit(0.0))


def int_or_null(value: Column) -> Column:
    """Truncated toward zero, NULL when it is no finite number."""
    return number_or_null(value).cast("bigint")


def truncate(value: Column) -> Column:
    return value.cast("bigint")


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("bigint"))


def protocol_by_name(name: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(name)), PROTOCOL_BY_NAME), F.lit("other"))


def protocol_by_number(number: Column) -> Column:
    return F.coalesce(lookup(number.cast("int"), PROTOCOL_BY_NUMBER), F.lit("other"))


def protocol_by_port(dest: Column, source: Column) -> Column:
    """Well-known port of either side, destination first."""
    return F.coalesce(lookup(dest.cast("int"), PROTOCOL_BY_PORT), lookup(source.cast("int"), PROTOCOL_BY_PORT),
                      F.lit("other"))


def hashed_host(prefix: str, *parts: Column) -> Column:
    """``prefix`` plus two octets from the third and fourth byte of sha256 of the joined parts."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    octet = lambda at: F.conv(F.substring(digest, at, 2), 16, 10)
    return F.concat_ws(".", F.lit(prefix), octet(5), octet(7))


def port_host(prefix: str, port: Column) -> Column:
    """A port as an address; distinct ports give distinct hosts."""
    p = F.coalesce(F.least(F.greatest(port.cast("int"), F.lit(0)), F.lit(65535)), F.lit(0))
    return F.concat_ws(".", F.lit(prefix), F.shiftright(p, 8).cast("string"), p.bitwiseAND(F.lit(255)).cast("string"))


def spread_bucket(count: Column) -> Column:
    return F.least(F.floor(count / 25).cast("bigint"), F.lit(10).cast("bigint"))


def session_part(category: Column, position: Column) -> Column:
    """Attack rows share one session, all other rows are their own."""
    return F.when(category.isin("dos", "probe"), F.lit(0).cast("bigint")).otherwise(position)


def kdd_hosts(category: Column, protocol: Column, service: Column, flag: Column, host_count: Column,
              position: Column) -> tuple[Column, Column]:
    source = hashed_host("10.10", protocol, service, flag, spread_bucket(host_count), session_part(category, position))
    return source, hashed_host("10.20", service, F.pmod(position, F.lit(4999)))


def nb15_hosts(category: Column, protocol: Column, service: Column, state: Column, same_service: Column,
               position: Column) -> tuple[Column, Column]:
    bucket = spread_bucket(same_service)
    source = hashed_host("10.10", protocol, service, state, bucket, session_part(category, position))
    spread = F.pmod(position, F.lit(4999)).cast("string")
    key = (F.when(category == "probe", spread)
           .when(category == "dos", F.concat(F.lit("victim:"), bucket.cast("string")))
           .otherwise(F.concat(service, F.lit(":"), spread)))
    return source, hashed_host("10.20", service, key)


def dns_bytes(name_length: Column) -> Column:
    return at_least_zero(truncate(number_or_zero(name_length))) + DNS_OVERHEAD_BYTES


def feature_map(columns: Sequence[str]) -> Column:
    """Finite numeric columns as a map; entries that are no number are left out."""
    keep = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                             F.array(*[number_or_null(F.col(f"`{c}`")) for c in columns]))
    return F.map_filter(keep, lambda _, v: v.isNotNull())


def feature_map_zero(columns: Sequence[str]) -> Column:
    """Numeric columns as a map, bad values as 0."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                             F.array(*[number_or_zero(F.col(f"`{c}`")) for c in columns]))


def flows_to_events(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Flow rows to telemetry events; negative sizes and durations clamp to 0."""
    identity = F.sha2(F.concat_ws("|", "source_ip", "dest_ip", F.col(ts).cast("string"),
                                  F.col("total_bytes").cast("string"), F.col("duration_ms").cast("string")), 256)
    return rows.select(
        (F.col("event_id").cast("string") if "event_id" in rows.columns else identity).alias("event_id"),
        F.col(ts).alias("ts"), "source_ip", "dest_ip", "source_port", "dest_port", "protocol",
        at_least_zero(F.col("total_bytes")).alias("bytes"), at_least_zero(F.col("duration_ms")).alias("duration_ms"),
        F.lit("zeek").alias("sensor"))


def sessions_to_events(sessions: DataFrame) -> DataFrame:
    """Decoy sessions to honeypot events; the duration is end minus start in milliseconds."""
    length = ((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000).cast("bigint")
    return sessions.select(
        F.col("session_id").alias("event_id"), F.col("ended_at").alias("ts"), "source_ip",
        F.lit("internal").alias("dest_ip"), F.lit(None).cast("int").alias("source_port"), "dest_port",
        F.lit("tcp").alias("protocol"), F.lit(0).cast("bigint").alias("bytes"), length.alias("duration_ms"),
        F.lit("honeypot").alias("sensor"), F.lit(None).cast("struct<process:string,syscall:string>").alias("host_event"),
        F.struct("decoy_service", "credentials_tried", "commands_typed", length.alias("session_duration_ms"))
        .alias("honeypot_detail"))


def with_endpoints(rows: DataFrame) -> DataFrame:
    """Drops rows that cannot be placed between two hosts."""
    present = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return rows.filter(present(F.col("source_ip")) & present(F.col("dest_ip")))
