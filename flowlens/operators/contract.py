"""Contract checks: every row gets a ``reject_reason`` (NULL when valid), nothing is coerced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schemas as S


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The first failed check's name; a check that is NULL counts as failed."""
    reason = None
    for name, passed in checks:
        failed = ~F.coalesce(passed, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return reason


def check_events(events: DataFrame) -> DataFrame:
    detail = F.col("honeypot_detail").isNull() if "honeypot_detail" in events.columns else F.lit(True)
    return events.withColumn("reject_reason", first_reason(
        ("missing_endpoint", (F.col("source_ip") != "") & (F.col("dest_ip") != "")),
        ("unknown_protocol", F.col("protocol").isin(*S.PROTOCOLS)),
        ("negative_bytes", F.col("bytes") >= 0),
        ("negative_duration", F.col("duration_ms") >= 0),
        ("unknown_sensor", F.col("sensor").isin(*S.SENSORS)),
        ("unexpected_honeypot_detail", detail | (F.col("sensor") == "honeypot"))))


def check_verdicts(verdicts: DataFrame) -> DataFrame:
    graphless = F.col("tier").isin("bouncer", "decoy")
    evidence = F.size(F.coalesce(F.col("node_ids"), F.array().cast("array<string>"))) + F.size(
        F.coalesce(F.col("edge_ids"), F.array().cast("array<string>")))
    return verdicts.withColumn("reject_reason", first_reason(
        ("unknown_tier", F.col("tier").isin(*S.TIERS)),
        ("unknown_label", F.col("label").isin(*S.LABELS)),
        ("confidence_out_of_range", F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence")),
        ("unknown_attribution", F.col("attribution_method").isin(*S.ATTRIBUTIONS)),
        ("decoy_confidence", (F.col("tier") != "decoy") | (F.col("confidence") == 1.0)),
        ("unexpected_evidence", ~graphless | (evidence == 0))))


def check_decisions(decisions: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(r) for r in S.REASONS])
    return decisions.withColumn("reject_reason", first_reason(
        ("unknown_action", F.col("action").isin(*S.ACTIONS)),
        ("unknown_reason", F.forall("reason_codes", lambda r: F.array_contains(known, r))),
        ("ttl_without_block", (F.col("action") == "block") | F.col("ttl_seconds").isNull())))


def check_audit(entries: DataFrame) -> DataFrame:
    return entries.withColumn("reject_reason", first_reason(
        ("unknown_entry_type", F.col("entry_type").isin(*S.ENTRY_TYPES)),
        ("bad_actor", (F.col("actor") == "system") | F.col("actor").startswith("operator:"))))


def parse_events(raw: DataFrame, value: str = "value", schema: T.StructType = S.EVENT,
                 required: Sequence[str] = ("source_ip", "dest_ip", "protocol", "bytes", "duration_ms", "sensor"),
                 ) -> DataFrame:
    """JSON messages to events. Broken JSON, unknown fields and missing fields are refused by name."""
    body = F.col(value).cast("string")
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    parsed = (raw.withColumn("_e", F.from_json(body, corrupt, options))
              .withColumn("_fields", F.json_object_keys(body)))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(f"_e.{name}").isNull()
    early = (F.when(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | F.col("_fields").isNull(), "malformed_json")
             .when(F.size(F.array_except("_fields", names)) > 0, "unknown_field")
             .when(missing, "missing_field"))
    rows = parsed.withColumn("_early", early).select(
        *raw.columns, *[F.col(f"_e.{f.name}").alias(f.name) for f in schema.fields], "_early")
    checked = check_events(rows)
    return checked.withColumn("reject_reason", F.coalesce("_early", "reject_reason")).drop("_early")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def refused(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNotNull())


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Counts of one ingest batch."""
    return rows.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("refused"))


def require_real(rows: DataFrame, origin: str = "origin") -> DataFrame:
    """Training input guard: a row of any other origin fails the job."""
    stop = F.raise_error(F.concat(F.lit("training input must be real, found "), F.coalesce(F.col(origin), F.lit("null"))))
    return rows.filter(F.when(F.col(origin) == "real", F.lit(True)).otherwise(stop.cast("boolean")))
