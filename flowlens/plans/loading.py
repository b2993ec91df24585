"""Queries: readers and sinks over files that Spark writes from the driver tables.

Each query writes ``events`` in the layout of a release into the shared folder, reads it back through the reader and
compares what the reader makes of every row with SQL over the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import fields as V
from flowlens.operators import decide, quality, sampling
from flowlens.plans.decisions import LOG, entries
from flowlens.plans.registry import FLOW, flow, query
from flowlens.session import shared_folder
from flowlens.sources import streams
from flowlens.sources.datasets import DNS_FEATURES, KDD_COLUMNS, read_flows, usable


def folder(spark) -> str:
    """A new folder in the shared space, removed when the JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_csv(rows: DataFrame, path: str, header: bool = True, encoding: str = "UTF-8") -> None:
    rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]).write.option("header", header).option(
        "encoding", encoding).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"), F.sum("duration_ms").alias("duration_ms"),
        F.min("dest_port").alias("low_port"), F.max("dest_port").alias("high_port"))


TOTALS = "count(*) as n, sum(bytes)::bigint as bytes, sum(ms)::bigint as duration_ms, min(port)::integer as low_port, max(port)::integer as high_port"


@query("read_ids2018", f"""with {FLOW}, r as (
 select seq, port, bytes, duration_ms as ms, case port % 3 when 0 then 'tcp' when 1 then 'udp' else 'other' end as protocol,
  ts_us // 1000000 as sec, case dst when 'error' then 'dos' when 'click' then 'probe' when 'view' then 'normal' end as category,
  case dst when 'purchase' then 'header_row' when 'signup' then 'unmapped:Brute Force -Web' end as reject_reason from flow)
select category, reject_reason, protocol, {TOTALS}, min(sec)::bigint as first_second, max(sec)::bigint as last_second from r group by all""")
def read_ids2018(spark, sf):
    label = (F.when(F.col("dst") == "error", "DoS  attacks–Hulk").when(F.col("dst") == "click", " Infilteration")
             .when(F.col("dst") == "view", "Benign").when(F.col("dst") == "purchase", "Label").otherwise("Brute Force -Web"))
    rows = flow(spark, sf).select(
        F.col("port").alias("Dst Port"), F.element_at(F.array(F.lit(6), F.lit(17), F.lit(99)), F.col("port") % 3 + 1).alias(" Protocol"),
        F.date_format(F.timestamp_micros("ts_us"), "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        (F.col("duration_ms") * 1000 + 7).alias("Flow Duration"), F.col("bytes").alias("TotLen Fwd Pkts"),
        F.lit(0).alias("TotLen Bwd Pkts"), F.lit("Infinity").alias("Flow Byts/s"), label.alias("Label"))
    path = folder(spark)
    write_csv(rows, path)
    got = read_flows(spark, "ids2018", path)
    second = F.unix_seconds("ts")
    return got.groupBy("category", "reject_reason", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"), F.sum("duration_ms").alias("duration_ms"),
        F.min("dest_port").alias("low_port"), F.max("dest_port").alias("high_port"),
        F.min(second).alias("first_second"), F.max(second).alias("last_second"))


@query("read_ids2017", f"""with {FLOW}, r as (
 select port, bytes, greatest(duration_ms - 100, 0) as ms, case dst when 'error' then 'dos' when 'click' then 'probe' when 'view' then 'normal' else 'r2l' end as category,
  dst = 'signup' as foreign_label from flow)
select category, {TOTALS} from r where not foreign_label group by all""")
def read_ids2017(spark, sf):
    label = (F.when(F.col("dst") == "error", "DDoS").when(F.col("dst") == "click", "PortScan").when(F.col("dst") == "view", "BENIGN")
             .when(F.col("dst") == "purchase", "Web Attack – XSS").otherwise("Mystery"))
    rows = flow(spark, sf).select(
        F.lit("1.1.1.1").alias(" Source IP"), F.lit(9).alias(" Source Port"), F.lit("2.2.2.2").alias(" Destination IP"),
        F.col("port").alias(" Destination Port"), F.lit(6).alias(" Protocol"), ((F.col("duration_ms") - 100) * 1000).alias(" Flow Duration"),
        F.col("bytes").alias(" Total Length of Fwd Packets"), F.lit("0").alias(" Total Length of Bwd Packets"), label.alias(" Label"))
    path = folder(spark)
    write_csv(rows, path)
    return totals(usable(read_flows(spark, "ids2017", path)), "category")


@query("read_kdd", f"""with {FLOW}, r as (
 select bytes, duration_ms * 1000 as ms, case port % 2 when 0 then 80 else 6000 end as port,
  case dst when 'error' then 'dos' when 'click' then 'probe' when 'view' then 'normal' when 'purchase' then 'u2r' else 'r2l' end as category from flow)
select category, {TOTALS} from r group by all""")
def read_kdd(spark, sf):
    label = (F.when(F.col("dst") == "error", "neptune").when(F.col("dst") == "click", "satan").when(F.col("dst") == "view", "normal")
             .when(F.col("dst") == "purchase", "rootkit").otherwise("something new"))
    given = {"duration": F.col("duration_ms"), "protocol_type": F.lit("tcp"), "flag": F.lit("SF"), "src_bytes": F.col("bytes"),
             "service": F.when(F.col("port") % 2 == 0, "http").otherwise("X11"), "label": label}
    rows = flow(spark, sf).select([given.get(c, F.lit(0)).alias(c) for c in KDD_COLUMNS])
    path = folder(spark)
    write_csv(rows, path, header=False)
    return totals(usable(read_flows(spark, "nsl_kdd", path)), "category")


@query("read_nb15", f"""with {FLOW}, r as (
 select bytes, duration_ms as ms, case port % 2 when 0 then 53 else 21 end as port,
  case dst when 'error' then 'dos' when 'click' then 'probe' when 'view' then 'normal' else 'r2l' end as category from flow)
select category, {TOTALS} from r group by all""")
def read_nb15(spark, sf):
    label = (F.when(F.col("dst") == "error", "DoS").when(F.col("dst") == "click", " Reconnaissance ").when(F.col("dst") == "view", "Normal")
             .when(F.col("dst") == "purchase", "Exploits").otherwise("Fuzzers"))
    rows = flow(spark, sf).select(
        F.col("seq").alias("﻿id"), (F.col("duration_ms") / 1000).alias("dur"), F.lit("tcp").alias("proto"),
        F.when(F.col("port") % 2 == 0, "dns").otherwise("ftp").alias("service"), F.lit("FIN").alias("state"),
        F.col("bytes").alias("sbytes"), F.lit(0).alias("dbytes"), F.lit(30).alias("ct_srv_src"), label.alias("attack_cat"), F.lit(1).alias("label"))
    path = folder(spark)
    write_csv(rows, path)
    return totals(usable(read_flows(spark, "nb15", path)), "category")


@query("read_doh", f"""with {FLOW}, r as (select bytes, duration_ms as ms, 443 as port,
 case when dst = 'error' then 'lateral_movement' else 'normal' end as category, port % 10 = 0 as lost from flow)
select category, case when lost then 'missing_endpoint' end as reject_reason, {TOTALS} from r group by all""")
def read_doh(spark, sf):
    path = folder(spark)
    for name, rows in (("bad", flow(spark, sf).filter("dst = 'error'")), ("good", flow(spark, sf).filter("dst <> 'error'"))):
        write_csv(rows.select(
            F.when(F.col("port") % 10 == 0, " ").otherwise("1.1.1.1").alias("SourceIP"), F.lit("2.2.2.2").alias("DestinationIP"),
            F.lit(50000).alias("SourcePort"), F.lit(443).alias("DestinationPort"),
            F.timestamp_micros("ts_us").alias("TimeStamp"), (F.col("duration_ms") / 1000).alias("Duration"),
            F.col("bytes").alias("FlowBytesSent"), F.lit(0).alias("FlowBytesReceived"),
            F.lit("dns2tcp" if name == "bad" else "Benign").alias("Label")), f"{path}/{name}")
    return totals(read_flows(spark, "doh2020", path), "category", "reject_reason")


@query("read_dns_guarded", f"""with {FLOW}, r as (select ts_us, seq, dst in ('view', 'click') as good, port % 40 as len, bytes % 997 as labels from flow),
v as (select len, labels, count(distinct good) as classes from r group by all),
t as (select r.*, classes, row_number() over (partition by r.good, r.len, r.labels order by ts_us, seq) as i from r join v on r.len = v.len and r.labels = v.labels)
select case when good then 'normal' else 'lateral_movement' end as category,
 case when classes > 1 then 'ambiguous_vector' when i > 1 then 'duplicate_vector' end as reject_reason, count(*) as n, sum(len + 44)::bigint as bytes from t group by all""")
def read_dns_guarded(spark, sf):
    path = folder(spark)
    given = {"len": F.col("port") % 40, "labels": F.col("bytes") % 997, "sld": F.lit("x"), "longest_word": F.lit("y")}
    for name, kept in (("benign_labeled", "dst in ('view', 'click')"), ("heavy_attack_labeled", "dst not in ('view', 'click')")):
        write_csv(flow(spark, sf).filter(kept).select(
            F.timestamp_micros("ts_us").alias("timestamp"), *[given.get(c, F.lit(1)).alias(c) for c in DNS_FEATURES]), f"{path}/{name}")
    return read_flows(spark, "dnsexf2021", path).groupBy("category", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_bytes").alias("bytes"))


@query("map_key_quality", f"""with {FLOW}, v as (select port % 30 as a, duration_ms % 3 as b, dst, count(*) as n from flow group by all),
k as (select a, b, count(*) as classes, sum(n) as n, max(n) as most from v group by all)
select count(*) as vectors, count(*) filter (where classes > 1) as ambiguous, sum(n)::bigint as rows, sum(most)::bigint as majority_rows from k""")
def map_key_quality(spark, sf):
    numbers = flow(spark, sf).select("dst", (F.col("port") % 30).alias("a"), (F.col("duration_ms") % 3).alias("b"))
    keyed = numbers.withColumn("features", V.feature_map(["b", "a"])).withColumn("key", quality.map_key())
    per = quality.per_vector(quality.vector_classes(keyed, "key", "dst"), "key")
    return per.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("classes") > 1).alias("ambiguous"),
                   F.sum("rows").alias("rows"), F.sum("majority").alias("majority_rows"))


@query("decoy_events", f"""with {FLOW} select 's' || seq as event_id, ts_us, '10.0.0.' || (src % 50) as source_ip, 'internal' as dest_ip, port as dest_port,
 duration_ms::bigint as duration_ms, 'honeypot' as sensor, 'ssh' as decoy_service, 2 as credentials from flow where dst = 'view'""")
def decoy_events(spark, sf):
    ended = F.timestamp_micros("ts_us")
    sessions = flow(spark, sf).filter("dst = 'view'").select(
        F.concat(F.lit("s"), "seq").alias("session_id"), F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("source_ip"),
        F.col("port").alias("dest_port"), F.timestamp_micros(F.col("ts_us") - F.col("duration_ms") * 1000).alias("started_at"),
        ended.alias("ended_at"), F.lit("ssh").alias("decoy_service"), F.array(F.lit("a"), F.lit("b")).alias("credentials_tried"),
        F.array(F.lit("ls")).alias("commands_typed"))
    return V.sessions_to_events(sessions).select(
        "event_id", F.unix_micros("ts").alias("ts_us"), "source_ip", "dest_ip", "dest_port", "duration_ms", "sensor",
        F.col("honeypot_detail.decoy_service").alias("decoy_service"), F.size("honeypot_detail.credentials_tried").alias("credentials"))


@query("evidence_targets", f"""with {FLOW} select seq, case when port % 3 = 0 then '10.0.0.' || src else 'host' || (port % 5) end as target from flow""")
def evidence_targets(spark, sf):
    rows = flow(spark, sf).select(
        "seq", F.concat(F.lit("10.0.0."), F.col("src").cast("string")).alias("source"),
        F.when(F.col("port") % 3 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("host"), (F.col("port") % 5).cast("string")), F.lit("other"))).alias("node_ids"))
    return rows.select("seq", decide.target_of("node_ids", "source").alias("target"))


@query("log_roundtrip", LOG + """ select chain, entry_type, count(*) as n, min(ts_us)::bigint as first_us, max(ts_us)::bigint as last_us from t group by all""")
def log_roundtrip(spark, sf):
    path = folder(spark)
    log = entries(spark, sf)
    for part in (0, 1):  # two appends
        streams.append_log(log.filter(F.pmod("chain", F.lit(2)) == part), path)
    return streams.read_log(spark, path).groupBy("chain", "entry_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("json_sinks", f"""with {FLOW} select dst, count(*) as n, sum(bytes)::bigint as bytes, 1 as reports from flow group by all""")
def json_sinks(spark, sf):
    path = folder(spark)
    rows = flow(spark, sf).select("seq", "dst", "bytes")
    streams.write_events_json(rows, f"{path}/events")
    back = spark.read.schema(rows.schema).json(f"{path}/events")
    counted = back.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    streams.write_report(counted, f"{path}/report")
    return spark.read.schema(counted.schema).json(f"{path}/report").withColumn("reports", F.lit(1))


@query("keyed_stream_messages", f"""with {FLOW} select '10.0.0.' || src as key, count(*) as n, sum(bytes)::bigint as bytes from flow group by all""")
def keyed_stream_messages(spark, sf):
    events = flow(spark, sf).select("seq", F.concat(F.lit("10.0.0."), F.col("src").cast("string")).alias("source_ip"), "bytes")
    sent = streams.keyed_messages(events)
    return sent.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("value", "$.bytes").cast("bigint")).alias("bytes"))


@query("chronological_ends", f"""with {FLOW}, o as (select seq, row_number() over (order by case when port % 9 = 0 then null else ts_us end nulls last, seq) as i,
 count(*) over () as n from flow) select i, seq from o where i <= 50 or i > n - 50""")
def chronological_ends(spark, sf):
    """Capture order, written and read back: the first and last fifty rows."""
    rows = flow(spark, sf).select("seq", F.when(F.col("port") % 9 != 0, F.col("ts_us")).alias("ts_us"))
    path = folder(spark)
    sampling.chronological(rows).write.parquet(path)
    kept = spark.read.parquet(path)
    order = ["_late", "_at", "seq"]
    keyed = kept.withColumn("_late", F.when(F.col("ts_us").isNull(), 1).otherwise(0)).withColumn("_at", F.coalesce("ts_us", F.lit(0)))
    placed = sampling.row_positions(keyed, order, name="i").withColumn("i", F.col("i") + 1)
    n = placed.agg(F.count(F.lit(1))).scalar()
    return placed.filter((F.col("i") <= 50) | (F.col("i") > n - 50)).select("i", "seq")
