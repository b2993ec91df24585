"""Table shapes, vocabularies and thresholds of the wire contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the wire contract.
PROTOCOLS = ("tcp", "udp", "icmp", "other")
SENSORS = ("zeek", "softflowd", "falco", "honeypot")
TIERS = ("bouncer", "detective", "decoy")
LABELS = ("flood", "port_scan", "lateral_movement", "benign", "uncertain", "decoy_interaction")
ATTRIBUTIONS = ("gnn_explainer", "attention_rollout", "rate_threshold", "honeypot_interaction")
ACTIONS = ("block", "dry_run", "allowlist_exempt", "throttled")
ACTING_ACTIONS = ("block", "allowlist_exempt", "throttled")
REASONS = (
    "confidence_above_threshold", "on_allowlist", "gray_zone",
    "circuit_breaker_exceeded", "below_gray_zone", "window_already_resolved",
)
ENTRY_TYPES = ("detection", "explanation", "policy_decision", "enforcement", "correction")
CORRECTIONS = ("false_positive", "true_positive", "false_negative")
ORIGINS = ("real", "synthetic", "decoy_captured")

BLOCK_AT = 0.85
GRAY_FROM = 0.50
BLOCK_TTL_SECONDS = 900
BREAKER_CAP = 20
BREAKER_WINDOW_SECONDS = 60
WINDOW_SECONDS = 2.0
ATTACK_GUARD_SECONDS = 3.0
FLOW_IDLE_SECONDS = 30.0
FLOW_ACTIVE_SECONDS = 120.0
PSI_BREACH = 0.2
KS_SIGNIFICANCE = 0.05
GENESIS_HASH = "0" * 64

MICROS = 1_000_000

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("host_event", T.StructType([
        T.StructField("process", T.StringType()),
        T.StructField("syscall", T.StringType()),
    ])),
    T.StructField("honeypot_detail", T.StructType([
        T.StructField("decoy_service", T.StringType()),
        T.StructField("credentials_tried", T.ArrayType(T.StringType())),
        T.StructField("commands_typed", T.ArrayType(T.StringType())),
        T.StructField("session_duration_ms", T.LongType()),
    ])),
])

FLOW_ROW = T.StructType([
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("raw_label", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("difficulty", T.IntegerType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("origin", T.StringType()),
])

DECOY_SESSION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("decoy_service", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("credentials_tried", T.ArrayType(T.StringType())),
    T.StructField("commands_typed", T.ArrayType(T.StringType())),
])

PACKET = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("drop_reason", T.StringType()),
])

AUDIT_ENTRY = T.StructType([
    T.StructField("chain", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("entry_id", T.StringType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("entry_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("prev_hash", T.StringType()),
    T.StructField("entry_hash", T.StringType()),
])
