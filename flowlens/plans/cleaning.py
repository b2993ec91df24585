"""Queries: label mapping, number cleaning, reconstructed hosts, contract checks, event projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import fields, labels
from flowlens.operators import contract, quality
from flowlens.plans.registry import FLOW, flow, query, r6, table

# Raw labels in the spellings the releases use, dealt out by event id.
RAW = ("BENIGN", "DoS  Hulk", " DDoS", "PortScan", "Web Attack – Brute Force", "Web Attack — XSS", "Bot", "FTP-Patator",
       "DDoS attacks-LOIC-HTTP", "DDOS attack-HOIC", "Infilteration", "DrDoS_LDAP", "DrDoS UDP", "UDP-lag", "Syn",
       "Label", "SSH-Bruteforce", "", "Heartbleed", "Web Attack -Sql Injection")
RAW_SQL = "[" + ", ".join("'" + r + "'" for r in RAW) + "]"


def raw_labels(spark, sf):
    f = flow(spark, sf)
    return f.select("seq", F.element_at(F.array(*[F.lit(r) for r in RAW]), F.pmod("seq", F.lit(len(RAW))).cast("int") + 1).alias("raw"))


@query("label_mapping", f"""with {FLOW}, r as (select seq, {RAW_SQL}[(seq % {len(RAW)}) + 1] as raw from flow),
c as (select *, lower(regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(raw, '–', '-'), '—', '-'), '\\s+', ' ', 'g')), ' - ', '-', 'g'), '(- | -)', '-', 'g')) as a,
 lower(trim(regexp_replace(replace(replace(raw, '–', '-'), '—', '-'), '\\s+', ' ', 'g'))) as b,
 trim(regexp_replace(lower(trim(raw)), '[- \\t_]+', '_', 'g'), '_') as d from r),
m as (select seq,
 case when a in ('benign') then 'normal' when a in ('dos hulk', 'dos goldeneye', 'dos slowloris', 'dos slowhttptest', 'ddos', 'heartbleed') then 'dos'
  when a = 'portscan' then 'probe' when a = 'infiltration' then 'u2r' when a in ('ftp-patator', 'ssh-patator', 'bot', 'web attack-brute force',
  'web attack-xss', 'web attack-sql injection') then 'r2l' end as c2017,
 case when b = 'benign' then 'normal' when b like 'dos attack%' or b like 'ddos attack%' then 'dos' when b in ('infilteration', 'infiltration') then 'probe' end as c2018,
 case when d in ('benign', 'normal') then 'normal' when regexp_replace(d, '^drdos_?', '') in ('ldap', 'mssql', 'netbios', 'portmap', 'snmp', 'ssdp', 'udp',
  'udplag', 'syn', 'tftp', 'webddos', 'dns', 'ntp') then 'dos' end as c2019,
 lower(trim(raw)) = 'label' as header from c)
select *, case c2017 when 'normal' then 'benign' when 'dos' then 'flood' when 'probe' then 'port_scan' end as label2017 from m""")
def label_mapping(spark, sf):
    raw = F.col("raw")
    return raw_labels(spark, sf).select(
        "seq", labels.category_2017(raw).alias("c2017"), labels.category_2018(raw).alias("c2018"),
        labels.category_2019(raw).alias("c2019"), labels.is_header_row(raw).alias("header"),
        labels.verdict_label(labels.category_2017(raw)).alias("label2017"))


@query("drop_accounting", f"""with {FLOW}, r as (select {RAW_SQL}[(seq % {len(RAW)}) + 1] as raw from flow),
x as (select case when raw = 'Label' then 'header_row' when lower(raw) <> 'benign' and not (lower(raw) like 'dos attack%' or lower(raw) like 'ddos attack%')
 and lower(raw) not in ('infilteration', 'infiltration') then 'unmapped:' || trim(raw) end as reject_reason from r)
select reject_reason, count(*) as n from x where reject_reason is not null group by 1""")
def drop_accounting(spark, sf):
    raw = F.col("raw")
    reason = F.when(labels.is_header_row(raw), "header_row").when(
        labels.category_2018(raw).isNull(), F.concat(F.lit("unmapped:"), F.trim(raw)))
    return quality.drop_counts(raw_labels(spark, sf).select(reason.alias("reject_reason")))


@query("numeric_clean", f"""with {FLOW}, r as (select seq, case when seq % 7 = 0 then 'Infinity' when seq % 11 = 0 then 'NaN' when seq % 13 = 0 then 'n/a'
 when seq % 17 = 0 then '' when seq % 19 = 0 then '-Infinity' when seq % 5 = 0 then ' ' || bytes || '.75 ' else cast(bytes as varchar) end as raw, bytes from flow)
select seq, case when seq % 7 = 0 or seq % 11 = 0 or seq % 13 = 0 or seq % 17 = 0 or seq % 19 = 0 then 0.0 when seq % 5 = 0 then bytes + 0.75 else bytes end::double as value,
 case when seq % 7 = 0 or seq % 11 = 0 or seq % 13 = 0 or seq % 17 = 0 or seq % 19 = 0 then null else bytes end as whole from r""")
def numeric_clean(spark, sf):
    s, b = F.col("seq"), F.col("bytes").cast("string")
    hit = lambda k: F.pmod(s, F.lit(k)) == 0
    raw = (F.when(hit(7), "Infinity").when(hit(11), "NaN").when(hit(13), "n/a").when(hit(17), "").when(hit(19), "-Infinity")
           .when(hit(5), F.concat(F.lit(" "), b, F.lit(".75 "))).otherwise(b))
    return flow(spark, sf).select("seq", fields.number_or_zero(raw).alias("value"), fields.int_or_null(raw).alias("whole"))


@query("protocol_and_port_mapping", f"""with {FLOW} select seq,
 case port % 20 when 6 then 'tcp' when 17 then 'udp' when 1 then 'icmp' else 'other' end as by_number,
 case dst when 'error' then 'tcp' else 'other' end as by_name,
 case when port in (53) then 'udp' when port in (80) then 'tcp' when duration_ms in (443, 80) then 'tcp' when duration_ms = 53 then 'udp' else 'other' end as by_port,
 case dst when 'error' then 80 when 'click' then 53 when 'view' then 22 end as service_port from flow""")
def protocol_and_port_mapping(spark, sf):
    name = F.when(F.col("dst") == "error", " TCP ").otherwise(F.col("dst"))
    service = F.when(F.col("dst") == "error", "http").when(F.col("dst") == "click", "domain_u").when(F.col("dst") == "view", "ssh").otherwise("-")
    return flow(spark, sf).select(
        "seq", fields.protocol_by_number(F.pmod("port", F.lit(20))).alias("by_number"), fields.protocol_by_name(name).alias("by_name"),
        fields.protocol_by_port(F.col("port"), F.col("duration_ms")).alias("by_port"),
        labels.lookup(service, fields.KDD_SERVICE_PORT).alias("service_port"))


HOST = """'10.{p}.' || cast(('0x' || substr({d}, 5, 2))::int as varchar) || '.' || cast(('0x' || substr({d}, 7, 2))::int as varchar)"""


@query("synthetic_hosts", f"""with {FLOW}, b as (select seq, least(port // 25, 10) as bucket, case dst when 'error' then 'dos' when 'click' then 'probe' else 'normal' end as category, dst from flow),
h as (select seq, sha256('tcp|' || dst || '|SF|' || bucket || '|' || case when category in ('dos', 'probe') then 0 else seq end) as s,
 sha256(dst || '|' || (seq % 4999)) as t,
 sha256(dst || '|' || case category when 'probe' then cast(seq % 4999 as varchar) when 'dos' then 'victim:' || bucket else dst || ':' || (seq % 4999) end) as u from b)
select seq, {HOST.format(p=10, d='s')} as source_ip, {HOST.format(p=20, d='t')} as dest_ip, {HOST.format(p=20, d='u')} as shaped_dest from h""")
def synthetic_hosts(spark, sf):
    f = flow(spark, sf)
    category = F.when(F.col("dst") == "error", "dos").when(F.col("dst") == "click", "probe").otherwise("normal")
    args = (category, F.lit("tcp"), F.col("dst"), F.lit("SF"), F.col("port"), F.col("seq"))
    source, dest = fields.kdd_hosts(*args)
    _, shaped = fields.nb15_hosts(*args)
    return f.select("seq", source.alias("source_ip"), dest.alias("dest_ip"), shaped.alias("shaped_dest"))


@query("port_bijection", f"""with {FLOW}, p as (select seq, least(65535, greatest(0, port * 701 - 300)) as p from flow)
select seq, '10.60.' || (p // 256) || '.' || (p % 256) as host from p""")
def port_bijection(spark, sf):
    return flow(spark, sf).select("seq", fields.port_host("10.60", F.col("port") * 701 - 300).alias("host"))


@query("path_class", """with t as (select page_id, string_split_regex(lower(url), '[^a-z0-9]+') as w from pages),
c as (select page_id, list_distinct([case when x in ('en', 'benign') then 'normal' else 'lateral_movement' end for x in w if x in ('en', 'benign', 'fr', 'm', 'heavy')]) as k from t)
select page_id, case when len(k) = 1 then k[1] else case when page_id % 3 = 0 then 'normal' end end as category from c""")
def path_class(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    words = {"en": "normal", "benign": "normal", "fr": "lateral_movement", "m": "lateral_movement", "heavy": "lateral_movement"}
    own = F.when(F.pmod("page_id", F.lit(3)) == 0, "benign row").otherwise("unknown")
    return pages.select("page_id", labels.path_class([F.col("url"), own], words).alias("category"))


@query("first_token_class", """with t as (select page_id, string_split_regex(lower(url), '[^a-z0-9]+') as w from pages)
select page_id, [case when x = 'en' then 'normal' else 'lateral_movement' end for x in w if x in ('en', 'fr', 'm')][1] as category from t""")
def first_token_class(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    words = {"en": "normal", "fr": "lateral_movement", "m": "lateral_movement"}
    return pages.select("page_id", labels.first_token_class(F.col("url"), words).alias("category"))


# Messages with every kind of fault, one per event.
MESSAGE = """m as (select seq, case when seq % 10 = 3 then '{"source_ip": "a", ' else
 '{"source_ip":"10.0.0.' || src || '","dest_ip":"' || dst || '","protocol":"' || case when seq % 10 = 4 then 'gre' else 'tcp' end
 || '","bytes":' || case when seq % 10 = 5 then -1 else bytes end || ',"duration_ms":' || duration_ms
 || case when seq % 10 = 6 then '' else ',"sensor":"' || case when seq % 10 = 7 then 'camera' else 'zeek' end || '"' end
 || case when seq % 10 = 8 then ',"surprise":1' else '' end
 || case when seq % 10 = 9 then ',"honeypot_detail":{"decoy_service":"ssh"}' else '' end || '}' end as value from flow)"""


def messages(spark, sf):
    s = F.pmod("seq", F.lit(10))
    body = F.concat(
        F.lit('{"source_ip":"10.0.0.'), F.col("src").cast("string"), F.lit('","dest_ip":"'), F.col("dst"), F.lit('","protocol":"'),
        F.when(s == 4, "gre").otherwise("tcp"), F.lit('","bytes":'), F.when(s == 5, F.lit("-1")).otherwise(F.col("bytes").cast("string")),
        F.lit(',"duration_ms":'), F.col("duration_ms").cast("string"),
        F.when(s == 6, "").otherwise(F.concat(F.lit(',"sensor":"'), F.when(s == 7, "camera").otherwise("zeek"), F.lit('"'))),
        F.when(s == 8, ',"surprise":1').otherwise(""), F.when(s == 9, ',"honeypot_detail":{"decoy_service":"ssh"}').otherwise(""), F.lit("}"))
    return flow(spark, sf).select("seq", F.when(s == 3, '{"source_ip": "a", ').otherwise(body).alias("value"))


@query("json_contract", f"""with {FLOW}, {MESSAGE}, p as (select seq, json_valid(value) as ok, case when json_valid(value) then value end as j from m),
x as (select seq, ok, json_extract_string(j, '$.protocol') as protocol, cast(json_extract_string(j, '$.bytes') as bigint) as bytes,
 json_extract_string(j, '$.sensor') as sensor, json_extract(j, '$.honeypot_detail') as detail,
 len([k for k in json_keys(j) if k not in ('event_id', 'ts', 'source_ip', 'dest_ip', 'source_port', 'dest_port', 'protocol', 'bytes', 'duration_ms',
  'sensor', 'host_event', 'honeypot_detail')]) as extra from p)
select seq, case when not ok then 'malformed_json' when extra > 0 then 'unknown_field' when sensor is null then 'missing_field'
 when protocol not in ('tcp', 'udp', 'icmp', 'other') then 'unknown_protocol' when bytes < 0 then 'negative_bytes'
 when sensor not in ('zeek', 'softflowd', 'falco', 'honeypot') then 'unknown_sensor'
 when detail is not null and sensor <> 'honeypot' then 'unexpected_honeypot_detail' end as reject_reason from x""")
def json_contract(spark, sf):
    return contract.parse_events(messages(spark, sf)).select("seq", "reject_reason")


@query("ingest_summary", f"with {FLOW} select count(*) as received, count(*) filter (seq % 10 in (0, 1, 2)) as accepted, count(*) filter (seq % 10 > 2) as refused from flow")
def ingest_summary(spark, sf):
    return contract.ingest_summary(contract.parse_events(messages(spark, sf)))


@query("verdict_contract", f"""with {FLOW}, v as (select seq, case when seq % 8 = 0 then 'spy' when seq % 8 = 1 then 'decoy' when seq % 8 < 5 then 'bouncer' else 'detective' end as tier,
 case when seq % 8 = 7 then 'worm' else 'flood' end as label, value / 250 as confidence, seq % 3 = 0 as graph from flow)
select seq, case when tier = 'spy' then 'unknown_tier' when label = 'worm' then 'unknown_label' when confidence > 1 then 'confidence_out_of_range'
 when tier = 'decoy' and confidence <> 1 then 'decoy_confidence' when tier in ('bouncer', 'decoy') and graph then 'unexpected_evidence' end as reject_reason from v""")
def verdict_contract(spark, sf):
    s = F.pmod("seq", F.lit(8))
    rows = flow(spark, sf).select(
        "seq", F.when(s == 0, "spy").when(s == 1, "decoy").when(s < 5, "bouncer").otherwise("detective").alias("tier"),
        F.when(s == 7, "worm").otherwise("flood").alias("label"), (F.col("value") / 250).alias("confidence"),
        F.when(F.pmod("seq", F.lit(3)) == 0, F.array(F.lit("h"))).alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"),
        F.lit("rate_threshold").alias("attribution_method"))
    return contract.check_verdicts(rows).select("seq", "reject_reason")


@query("event_projection", f"""with {FLOW} select seq, '10.0.0.' || src as source_ip, dst as dest_ip, port as dest_port,
 greatest(bytes - 5000, 0) as bytes, greatest(duration_ms - 100, 0) as duration_ms, 'zeek' as sensor from flow""")
def event_projection(spark, sf):
    rows = flow(spark, sf).select(
        F.col("seq").alias("event_id"), F.timestamp_micros("ts_us").alias("ts"), F.concat(F.lit("10.0.0."), F.col("src").cast("string")).alias("source_ip"),
        F.col("dst").alias("dest_ip"), F.lit(None).cast("int").alias("source_port"), F.col("port").alias("dest_port"), F.lit("tcp").alias("protocol"),
        (F.col("bytes") - 5000).alias("total_bytes"), (F.col("duration_ms") - 100).alias("duration_ms"))
    return fields.flows_to_events(rows).select(
        F.col("event_id").cast("bigint").alias("seq"), "source_ip", "dest_ip", "dest_port", "bytes", "duration_ms", "sensor")


@query("derived_sizes", f"""with {FLOW} select seq, 44 + port as dns_bytes, cast(trunc(value * 1000 / 1000.0) as bigint) as whole_ms,
 cast(round_even(value * 100, 0) as bigint) as rounded_ms, round(ln(1 + bytes), 6) as log_bytes from flow""")
def derived_sizes(spark, sf):
    return flow(spark, sf).select(
        "seq", fields.dns_bytes(F.col("port")).alias("dns_bytes"), fields.truncate(F.col("value") * 1000 / 1000.0).alias("whole_ms"),
        F.bround(F.col("value") * 100).cast("bigint").alias("rounded_ms"), r6(F.log1p("bytes")).alias("log_bytes"))


@query("endpoint_filter", f"with {FLOW} select seq from flow where port > 9 and dst <> 'view'")
def endpoint_filter(spark, sf):
    rows = flow(spark, sf).withColumn("source_ip", F.when(F.col("port") > 9, "a").otherwise(" ")).withColumn(
        "dest_ip", F.when(F.col("dst") != "view", "b"))
    return fields.with_endpoints(rows).select("seq")


@query("real_only", f"with {FLOW} select seq, 'real' as origin from flow")
def real_only(spark, sf):
    return contract.require_real(flow(spark, sf).select("seq", F.lit("real").alias("origin")))


@query("class_frame", f"""with {FLOW} select seq, case dst when 'error' then 'benign' when 'click' then 'port_scan' else 'benign' end as label
 from flow where dst in ('error', 'click', 'view')""")
def class_frame(spark, sf):
    named = flow(spark, sf).withColumn("label", F.when(F.col("dst") == "error", "flood").when(F.col("dst") == "click", "port_scan").when(
        F.col("dst") == "view", "benign").otherwise("other"))
    return labels.class_frame(named, "label", {"flood": "benign", "port_scan": "port_scan", "benign": "benign"}).select("seq", "label")
