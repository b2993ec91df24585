"""Queries: trailing features, host graphs, windows, intervals, flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import attention, flows, graph, separability, windows
from flowlens.operators.evaluate import long_form
from flowlens.operators.graph import WINDOW_VECTOR
from flowlens.operators.scan import exact_quantiles
from flowlens.operators.trailing import FEATURES, trailing_features
from flowlens.plans.registry import DAY, FLOW, HOUR, MINUTE, flow, query, rounded, table
from flowlens.session import cut_lineage


@query("trailing_features", f"""
with {FLOW},
w as (select e.seq, e.src, e.dst as mine, h.dst, h.port, h.bytes, h.duration_ms
      from flow e join flow h on h.src = e.src and h.seq <= e.seq
       and h.ts_us between e.ts_us - {DAY} and e.ts_us),
p as (select seq, -sum(q * log2(q)) as entropy from (
        select seq, count(*) / sum(count(*)) over (partition by seq) as q from w where port is not null
        group by seq, port) group by seq)
select w.src, w.seq, round(count(*) / {DAY / 1e6}, 9) as event_rate, round(sum(bytes) / {DAY / 1e6}, 9) as byte_rate,
       round(coalesce(max(p.entropy), 0), 6) + 0.0 as dest_port_entropy,
       cast(count(distinct dst) as double) as unique_dest_count, round(avg(duration_ms), 9) as avg_duration_ms,
       round(avg(case when dst = mine then 1.0 else 0.0 end), 9) as same_dest_ratio
from w left join p on p.seq = w.seq group by w.src, w.seq
""")
def trailing(spark, sf):
    out = trailing_features(flow(spark, sf), DAY, ["src"], bucket_windows=8)
    fine = [F.round(c, 6 if c == "dest_port_entropy" else 9).alias(c) for c in FEATURES]
    return out.select("src", "seq", *fine)


GRAPH_SQL = """
c as (select {w}, src, dst, port, count(*) as flows, sum(bytes) as bytes, sum(duration_ms) as duration
      from win group by all),
pe as (select {w}, src, dst, log2(sum(flows)) - sum(flows * log2(flows)) / sum(flows) as h
       from c where port is not null group by all),
edges as (select c.{w}, c.src, c.dst, cast(sum(bytes) as double) as bytes, cast(sum(flows) as bigint) as flow_count,
                 coalesce(max(pe.h), 0.0) as port_entropy, sum(duration) / sum(flows) as duration_mean_ms
          from c left join pe on pe.{w} = c.{w} and pe.src = c.src and pe.dst = c.dst group by c.{w}, c.src, c.dst),
nodes as (select {w}, node, cast(sum(i) as double) as degree_in, cast(sum(o) as double) as degree_out,
                 cast(sum(b) as double) as bytes_total, cast(count(distinct port) as bigint) as unique_ports_contacted
          from (select {w}, cast(src as varchar) as node, 0 as i, flows as o, bytes as b, port from c union all
                select {w}, cast(dst as varchar), flows, 0, bytes, null from c) group by all)
"""
HOURLY = f"with {FLOW}, win as (select *, ts_us - ts_us % {HOUR} as window_start from flow), " + GRAPH_SQL.format(w="window_start")


def hourly(spark, sf):
    rows = windows.aligned_windows(flow(spark, sf), HOUR).withColumn("src", F.col("src").cast("string"))
    return graph.port_counts(rows, ["window_start"])


@query("graph_edges_aligned", HOURLY + """
select window_start, src, dst, bytes, flow_count, round(port_entropy, 6) + 0.0 as port_entropy,
       round(duration_mean_ms, 6) as duration_mean_ms from edges""")
def graph_edges(spark, sf):
    out = graph.edges(hourly(spark, sf), ["window_start"]).withColumn("src", F.col("src").cast("bigint"))
    return rounded(out, "port_entropy", "duration_mean_ms")


@query("graph_nodes_aligned", HOURLY + "select * from nodes")
def graph_nodes(spark, sf):
    return graph.nodes(hourly(spark, sf), ["window_start"])


VECTOR_SQL = """
select e.*, n.n_nodes, n.max_unique_ports, n.max_degree_out, n.max_degree_in from
 (select window_start, cast(count(*) as double) as n_edges, round(avg(duration_mean_ms), 6) as mean_edge_duration_ms,
         round(avg(bytes), 6) as mean_edge_bytes, round(max(port_entropy), 6) + 0.0 as max_port_entropy,
         round(avg(flow_count), 6) as mean_flow_count from edges group by window_start) e
join (select window_start, cast(count(*) as double) as n_nodes,
             cast(max(unique_ports_contacted) as double) as max_unique_ports,
             max(degree_out) as max_degree_out, max(degree_in) as max_degree_in from nodes group by window_start) n
 on n.window_start = e.window_start"""


@query("window_vectors", HOURLY + VECTOR_SQL)
def window_vectors(spark, sf):
    return rounded(graph.window_vectors(hourly(spark, sf), ["window_start"]),
                   "mean_edge_duration_ms", "mean_edge_bytes", "max_port_entropy", "mean_flow_count")


MONTHLY = """with win as (
  select cast(extract(year from l_shipdate) * 12 + extract(month from l_shipdate) as bigint) as window_start,
         l_suppkey as src, l_partkey as dst, l_linenumber as port, cast(floor(l_extendedprice) as bigint) as bytes,
         cast(l_quantity as bigint) as duration_ms from lineitem), """ + GRAPH_SQL.format(w="window_start")


def monthly(spark, sf):
    items = table(spark, sf, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    return graph.port_counts(items.select(
        month.alias("window_start"), F.concat(F.lit("s"), "l_suppkey").alias("src"),
        F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_linenumber").alias("port"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes"), F.col("l_quantity").cast("bigint").alias("duration_ms")),
        ["window_start"])


@query("trade_graph_vectors", MONTHLY.replace("l_suppkey as src", "'s' || l_suppkey as src").replace(
    "l_partkey as dst", "'p' || l_partkey as dst") + VECTOR_SQL)
def trade_graph(spark, sf):
    return rounded(graph.window_vectors(monthly(spark, sf), ["window_start"]),
                   "mean_edge_duration_ms", "mean_edge_bytes", "max_port_entropy", "mean_flow_count")


@query("port_entropy", f"""
with {FLOW}, c as (select src, port, count(*) as n from flow where port is not null group by all)
select src, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 as entropy from c group by src""")
def port_entropy(spark, sf):
    return rounded(graph.entropy(flow(spark, sf), "port", ["src"]), "entropy")


ENDPOINTS_SQL = """
select e.window_start, e.src, e.dst, e.flow_count, round(ln(1 + e.bytes), 6) as log_bytes,
       s.degree_out as src_degree_out, s.unique_ports_contacted as src_ports, round(ln(1 + s.bytes_total), 6) as src_log_bytes,
       d.degree_in as dst_degree_in, round(ln(1 + d.bytes_total), 6) as dst_log_bytes
from edges e join nodes s on s.window_start = e.window_start and s.node = cast(e.src as varchar)
             join nodes d on d.window_start = e.window_start and d.node = e.dst"""


@query("edge_endpoints", HOURLY + ENDPOINTS_SQL)
def edge_endpoints(spark, sf):
    counted = hourly(spark, sf)
    out = graph.edge_endpoints(graph.edges(counted, ["window_start"]), graph.nodes(counted, ["window_start"]), ["window_start"])
    return rounded(out.select(
        "window_start", F.col("src").cast("bigint").alias("src"), "dst", "flow_count", "log_bytes", "src_degree_out",
        "src_ports", "src_log_bytes", "dst_degree_in", "dst_log_bytes"), "log_bytes", "src_log_bytes", "dst_log_bytes")


# --- anchored windows ---

ANCHORED = f"""with recursive {FLOW},
starts(stream, window_start) as (
  select stream, min(ts_us) from flow group by stream
  union all
  select s.stream, (select min(f.ts_us) from flow f where f.stream = s.stream and f.ts_us >= s.window_start + {{width}})
  from starts s where exists (select 1 from flow f where f.stream = s.stream and f.ts_us >= s.window_start + {{width}})),
spans as (select stream, window_start, lead(window_start) over (partition by stream order by window_start) as next_start
          from starts),
win as (select f.*, s.window_start, s.next_start from flow f asof join spans s
        on f.stream = s.stream and f.ts_us >= s.window_start)
"""


def anchored(spark, sf, width):
    return windows.anchored_windows(flow(spark, sf), width, ["stream"], segment_us=DAY)


@query("anchored_windows", ANCHORED.format(width=HOUR) + """
select stream, window_start, coalesce(max(next_start), max(ts_us)) as window_end,
       max(next_start) is not null as closed, count(*) as n_events from win group by stream, window_start""")
def anchored_windows(spark, sf):
    return windows.window_bounds(anchored(spark, sf, HOUR), ["stream"])


@query("anchored_edges", ANCHORED.format(width=HOUR) + """
select stream, window_start, src, dst, cast(sum(bytes) as double) as bytes, count(*) as flow_count,
       round(avg(duration_ms), 6) as duration_mean_ms from win group by all""")
def anchored_edges(spark, sf):
    counted = graph.port_counts(anchored(spark, sf, HOUR), ["stream", "window_start"])
    return rounded(graph.edges(counted, ["stream", "window_start"]).drop("port_entropy"), "duration_mean_ms")


@query("anchored_window_ids", ANCHORED.format(width=2 * HOUR) + """
select seq, sha256(concat_ws('|', stream, window_start)) as window_id from win""")
def anchored_window_ids(spark, sf):
    return anchored(spark, sf, 2 * HOUR).select("seq", windows.window_id(["stream"]).alias("window_id"))


CADENCES = (HOUR, 2 * HOUR, 6 * HOUR)
_guard = 10 * MINUTE
INTERVALS = f"""
att as (select stream, ts_us - {_guard} as a, ts_us + {_guard} as b from flow where dst = 'error'),
mark as (select *, case when a <= max(b) over (partition by stream order by a, b rows between unbounded preceding and 1 preceding)
                   then 0 else 1 end as opens from att),
numb as (select *, sum(opens) over (partition by stream order by a, b rows unbounded preceding) as island from mark),
spans_m as (select stream, min(a) as span_start, max(b) as span_end, count(*) as attack_rows from numb group by stream, island)"""


def attack_spans(spark, sf):
    rows = flow(spark, sf)
    return windows.merged_intervals(rows.filter(F.col("dst") == "error"), ["stream"], _guard)


#: A width that puts each stream in one window, so that one class is missing.
WHOLE = 4000 * DAY
CADENCE_LABELS = f"""with recursive {FLOW}, {INTERVALS},
widths as (select unnest([{', '.join(map(str, (*CADENCES, WHOLE)))}]) as cadence_us),
starts(cadence_us, stream, window_start) as (
  select cadence_us, stream, min(ts_us) from flow, widths group by all
  union all
  select s.cadence_us, s.stream,
         (select min(f.ts_us) from flow f where f.stream = s.stream and f.ts_us >= s.window_start + s.cadence_us)
  from starts s where exists (
    select 1 from flow f where f.stream = s.stream and f.ts_us >= s.window_start + s.cadence_us)),
win as (select s.cadence_us || '/' || s.stream || '/' || s.window_start as wk, f.src, f.dst, f.port, f.bytes, f.duration_ms
        from (select * from flow, widths) f
        asof join starts s on s.cadence_us = f.cadence_us and f.stream = s.stream and f.ts_us >= s.window_start),
""" + GRAPH_SQL.format(w="wk") + """, vec as (
 select string_split(e.wk, '/')[1]::bigint as cadence_us, string_split(e.wk, '/')[2]::bigint as stream,
        string_split(e.wk, '/')[3]::bigint as window_start, e.*, n.* exclude (wk) from
 (select wk, cast(count(*) as double) as n_edges, avg(duration_mean_ms) as mean_edge_duration_ms, avg(bytes) as mean_edge_bytes,
         max(port_entropy) as max_port_entropy, avg(flow_count) as mean_flow_count from edges group by wk) e
 join (select wk, cast(count(*) as double) as n_nodes, cast(max(unique_ports_contacted) as double) as max_unique_ports,
              max(degree_out) as max_degree_out, max(degree_in) as max_degree_in from nodes group by wk) n on n.wk = e.wk),
lab as (select v.*, exists (select 1 from spans_m i where i.stream = v.stream
                             and v.window_start between i.span_start and i.span_end) as is_attack from vec v)
"""
CADENCE_SQL = CADENCE_LABELS + "select cadence_us, is_attack, count(*) as n, " + ", ".join(
    f"round(quantile_cont({c}, 0.5), 6) + 0.0 as median_{c}" for c in WINDOW_VECTOR) + f" from lab where cadence_us < {WHOLE} group by all"


def labelled_cadences(spark, sf, cadences):
    """One row per window of every cadence: its vector and whether it starts inside an attack."""
    keys = ["cadence_us", "stream", "window_start"]
    rows = flow(spark, sf).select("stream", "ts_us", F.col("src").cast("string").alias("src"), "dst", "port", "bytes", "duration_ms")
    counted = graph.port_counts(windows.cadence_windows(rows, cadences, ["stream"]), keys)
    # Small next to the events, and read several times by what follows.
    return cut_lineage(windows.label_windows(graph.window_vectors(cut_lineage(counted), keys), attack_spans(spark, sf), ["stream"], DAY))


@query("cadence_sweep", CADENCE_SQL)
def cadence_sweep(spark, sf):
    """Window counts and the medians of all nine statistics, per cadence and class."""
    labelled = labelled_cadences(spark, sf, CADENCES)
    by = ["cadence_us", "is_attack"]
    medians = exact_quantiles(long_form(labelled, list(WINDOW_VECTOR), by), "value", {"median": 0.5}, [*by, "feature"])
    pick = lambda name: F.max(F.when(F.col("feature") == name, F.col("median"))).alias(f"median_{name}")
    out = medians.groupBy(*by).agg(F.max("n").alias("n"), *[pick(c) for c in WINDOW_VECTOR])
    return rounded(out, *[f"median_{c}" for c in WINDOW_VECTOR])


def probed_cadences(spark, sf):
    return labelled_cadences(spark, sf, (*CADENCES, WHOLE)).select(
        "*", F.col("is_attack").cast("int").alias("y"), F.concat_ws("/", "stream", "window_start").alias("window"))


SHARES_SQL = CADENCE_LABELS + """, m as (
select cadence_us, count(*) as windows, count(*) filter (is_attack) as attacks, """ + ", ".join(
    f"quantile_cont({c}, 0.5) filter (is_attack) as a_{c}, quantile_cont({c}, 0.5) filter (not is_attack) as b_{c}"
    for c in WINDOW_VECTOR) + """ from lab group by all),
k as (select *, attacks > 0 and attacks < windows as ok from m)
select cadence_us, windows, ok as available, case when not ok then 'degenerate label distribution' end as reason,
  case when ok then attacks end as attack_windows, case when ok then round(attacks / windows, 6) end as attack_fraction,
  case when ok then round(greatest(attacks / windows, 1 - attacks / windows), 6) end as majority_class_accuracy,
  case when ok then round(a_n_edges, 6) end as median_edges_attack, case when ok then round(b_n_edges, 6) end as median_edges_benign, """ + ", ".join(
    f"case when ok then round(a_{c} / nullif(b_{c}, 0), 6) + 0.0 end as ratio_{c}" for c in WINDOW_VECTOR) + " from k"
SHARES = ("attack_fraction", "majority_class_accuracy", "median_edges_attack", "median_edges_benign", *[f"ratio_{c}" for c in WINDOW_VECTOR])


@query("cadence_shares", SHARES_SQL)
def cadence_shares(spark, sf):
    """Label shares, medians and the nine ratios of every cadence; the longest one has a single class and says so."""
    return rounded(separability.label_shares(probed_cadences(spark, sf), ["cadence_us"]), *SHARES)


@query("cadence_separability")
def cadence_separability(spark, sf):
    """The same with the AUC and F1 of one balanced linear model per cadence and fold, all fitted together."""
    out = separability.separability(probed_cadences(spark, sf), ["cadence_us"], "window")
    return rounded(out, *SHARES, "auc", "f1_attack")


@query("attack_intervals", f"with {FLOW}, {INTERVALS} select * from spans_m")
def attack_intervals(spark, sf):
    return attack_spans(spark, sf)


@query("outside_attack_rows", f"""with {FLOW}, {INTERVALS}
select f.seq, f.stream, f.dst, exists (select 1 from spans_m i where i.stream = f.stream
       and f.ts_us between i.span_start and i.span_end) as in_attack from flow f""")
def outside_attack_rows(spark, sf):
    flagged = windows.in_intervals(flow(spark, sf), attack_spans(spark, sf), ["stream"], "ts_us", HOUR)
    return flagged.select("seq", "stream", "dst", "in_attack")


@query("labelled_windows", f"""with {FLOW}, {INTERVALS},
vec as (select stream, ts_us - ts_us % {HOUR} as window_start, count(distinct (src, dst)) as n_edges from flow group by all)
select v.*, exists (select 1 from spans_m i where i.stream = v.stream
       and v.window_start between i.span_start and i.span_end) as is_attack from vec v""")
def labelled_windows(spark, sf):
    pairs = windows.aligned_windows(flow(spark, sf), HOUR).groupBy("stream", "window_start", "src", "dst").agg(F.lit(1))
    counts = pairs.groupBy("stream", "window_start").agg(F.count(F.lit(1)).alias("n_edges"))
    return windows.label_windows(counts, attack_spans(spark, sf), ["stream"], DAY)


# --- flows ---

IDLE, ACTIVE = 6 * HOUR, 12 * HOUR


def packets(spark, sf):
    return flow(spark, sf).select(
        "seq", "ts_us", F.lit("c").alias("capture"),
        F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(10)).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), F.pmod("seq", F.lit(10)).cast("string")).alias("dst_ip"),
        F.lit(None).cast("int").alias("src_port"), F.lit(None).cast("int").alias("dst_port"),
        F.lit("icmp").alias("protocol"), F.col("bytes").cast("int").alias("length"))


@query("flow_assembly", f"""with recursive {FLOW},
pk as (select seq, ts_us, '10.0.0.' || (src % 10) as a, '10.0.0.' || (seq % 10) as b, bytes from flow),
keyed as (select *, least(a, b) as x, greatest(a, b) as y,
                 row_number() over (partition by least(a, b), greatest(a, b) order by ts_us, seq) as rn from pk),
walk(x, y, rn, start_us, at_us) as (
  select x, y, rn, ts_us, ts_us from keyed where rn = 1
  union all
  select k.x, k.y, k.rn,
         case when k.ts_us - w.at_us > {IDLE} or k.ts_us - w.start_us > {ACTIVE} then k.ts_us else w.start_us end, k.ts_us
  from walk w join keyed k on k.x = w.x and k.y = w.y and k.rn = w.rn + 1),
f as (select k.*, w.start_us from keyed k join walk w on k.x = w.x and k.y = w.y and k.rn = w.rn),
o as (select x, y, start_us, arg_min(a, rn) as source_ip, arg_min(b, rn) as dest_ip, min(ts_us) as t0, max(ts_us) as t1,
             count(*) as packets, cast(sum(bytes) as bigint) as total_bytes from f group by x, y, start_us)
select o.source_ip, o.dest_ip, o.start_us, o.t1 as end_us, o.packets, o.total_bytes,
       count(*) filter (f.a = o.source_ip) as packets_fwd, count(*) filter (f.a <> o.source_ip) as packets_bwd,
       coalesce(cast(sum(f.bytes) filter (f.a = o.source_ip) as bigint), 0) as bytes_fwd,
       coalesce(cast(sum(f.bytes) filter (f.a <> o.source_ip) as bigint), 0) as bytes_bwd,
       cast(round_even((o.t1 - o.t0) / 1000.0, 0) as bigint) as duration_ms,
       round(o.total_bytes / o.packets, 6) as mean_packet_bytes,
       round(case when round_even((o.t1 - o.t0) / 1000.0, 0) > 0
             then o.packets / (round_even((o.t1 - o.t0) / 1000.0, 0) / 1000.0) else 0.0 end, 6) as packet_rate_hz
from o join f on f.x = o.x and f.y = o.y and f.start_us = o.start_us group by all""")
def flow_assembly(spark, sf):
    out = flows.assemble_flows(packets(spark, sf), ["capture"], IDLE, ACTIVE, segment_us=2 * DAY)
    return rounded(out.select(
        "source_ip", "dest_ip", "start_us", "end_us", "packets", "total_bytes", "packets_fwd", "packets_bwd", "bytes_fwd",
        "bytes_bwd", "duration_ms", "mean_packet_bytes", "packet_rate_hz"), "mean_packet_bytes", "packet_rate_hz")


# --- attention step ---

SOFTMAX = """
raw as (select *, ln(1 + bytes) * 0.1 + flow_count * 0.05 as score from edges),
top as (select window_start, max(score) as peak from raw group by window_start),
ex as (select r.*, exp(r.score - t.peak) as e from raw r join top t on t.window_start = r.window_start),
den as (select window_start, dst, sum(e) as total from ex group by all),
att as (select ex.window_start, ex.src, ex.dst, ex.e / (d.total + 1e-12) as attention
        from ex join den d on d.window_start = ex.window_start and d.dst = ex.dst)
"""


def scored_edges(spark, sf):
    e = graph.edges(hourly(spark, sf), ["window_start"])
    return e.withColumn("score", F.log1p("bytes") * 0.1 + F.col("flow_count") * 0.05)


@query("segment_softmax", HOURLY + "," + SOFTMAX + """
select window_start, src, dst, round(attention, 6) as attention from att""")
def segment_softmax(spark, sf):
    out = attention.segment_softmax(scored_edges(spark, sf), ["window_start"], "score", "dst")
    return rounded(out.select("window_start", F.col("src").cast("bigint").alias("src"), "dst", "attention"), "attention")


@query("evidence_topk", HOURLY + "," + SOFTMAX + """,
k as (select *, row_number() over (partition by window_start order by round(attention, 9) desc, cast(src as varchar), dst) as rn from att)
select window_start, string_agg(src || '->' || dst, ',' order by rn) as top_edges,
  array_to_string(list_sort(list_distinct(flatten(list([cast(src as varchar), dst])))), ',') as nodes
from k where rn <= 3 group by window_start""")
def evidence_topk(spark, sf):
    att = attention.segment_softmax(scored_edges(spark, sf), ["window_start"], "score", "dst")
    out = attention.top_evidence(att, ["window_start"], "attention", 3)
    return out.select("window_start", F.array_join("edge_ids", ",").alias("top_edges"), F.array_join("node_ids", ",").alias("nodes"))


@query("empty_windows_benign", f"""
with {FLOW}, hours as (select distinct ts_us - ts_us % {HOUR} as window_start from flow),
s as (select ts_us - ts_us % {HOUR} as window_start, least(1.0, max(value) / 500) as c from flow where dst = 'error' group by all)
select h.window_start, case when s.c is null then 'benign' when s.c >= 0.85 then 'port_scan' when s.c >= 0.5 then 'uncertain'
       else 'port_scan' end as label, round(coalesce(s.c, 1.0), 6) as confidence
from hours h left join s on s.window_start = h.window_start""")
def empty_windows(spark, sf):
    rows = windows.aligned_windows(flow(spark, sf), HOUR)
    every = rows.select("window_start").distinct()
    scores = rows.filter(F.col("dst") == "error").groupBy("window_start").agg(
        F.least(F.lit(1.0), F.max("value") / 500).alias("confidence")).withColumn("predicted", F.lit("port_scan"))
    return rounded(attention.window_verdicts(every, scores, ["window_start"]), "confidence")
