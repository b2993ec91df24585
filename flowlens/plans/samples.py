"""Queries: deterministic samples, splits, hold-outs, quotas, label quality, hosts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import quality, sampling
from flowlens.plans.registry import DAY, FLOW, flow, query, rounded, table

NUMBERED = """n as (select o_orderkey, o_orderstatus, o_orderpriority,
  row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as position,
  count(*) over (partition by o_orderstatus) as size from orders)"""


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("file_positions", f"with {NUMBERED} select o_orderkey, o_orderstatus, position from n")
def file_positions(spark, sf):
    out = sampling.row_positions(orders(spark, sf), ["o_orderkey"], ["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", "position")


@query("stride_sample", f"with {NUMBERED} select o_orderkey, o_orderstatus, position from n where position % 7 = 0")
def stride_sample(spark, sf):
    out = sampling.stride(orders(spark, sf), ["o_orderkey"], 7, ["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", "position")


@query("budget_stride", f"""with {NUMBERED}, s as (select *, greatest(1, size // 600) as step from n)
select o_orderkey, o_orderstatus, position from s where position % step = 0 and position // step < 600""")
def budget_stride(spark, sf):
    out = sampling.budget_stride(orders(spark, sf), ["o_orderkey"], 600, ["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", "position")


EVEN = """with {numbered}, sizes as (select distinct o_orderstatus, size from n),
picks as (select o_orderstatus, {index} as position from sizes, range(0, 500) r(i))
select distinct n.o_orderkey, n.o_orderstatus, n.position from n join picks p
 on p.o_orderstatus = n.o_orderstatus and p.position = n.position"""


@query("even_sample_floor", EVEN.format(
    numbered=NUMBERED, index="least(size - 1, cast(floor(i * (cast(size as double) / 500)) as bigint))"))
def even_sample_floor(spark, sf):
    out = sampling.even_sample(orders(spark, sf), ["o_orderkey"], 500, ["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", "position")


@query("even_sample_linspace", EVEN.format(
    numbered=NUMBERED,
    index="case when i = 499 then size - 1 else cast(floor(i * (cast(size - 1 as double) / 499)) as bigint) end"))
def even_sample_linspace(spark, sf):
    out = sampling.even_sample(orders(spark, sf), ["o_orderkey"], 500, ["o_orderstatus"], linspace=True)
    return out.select("o_orderkey", "o_orderstatus", "position")


@query("prefix_limit", f"with {NUMBERED} select o_orderkey, o_orderstatus from n where position < 1500")
def prefix_limit(spark, sf):
    return sampling.prefix(orders(spark, sf), ["o_orderkey"], 1500, ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


SPLIT = """h as (select o_orderkey, {keys}, sha256('42:' || o_orderkey) as h from orders),
s as (select *, row_number() over (partition by {keys} order by h) - 1 as rk, count(*) over (partition by {keys}) as size from h)
select o_orderkey, {keys}, case when rk < floor(size * cast(0.67 as double)) then 'train' else 'test' end as side from s"""


@query("class_split", "with " + SPLIT.format(keys="o_orderstatus"))
def class_split(spark, sf):
    out = sampling.class_split(orders(spark, sf).drop("o_orderpriority"), ["o_orderstatus"], "o_orderkey")
    return out.select("o_orderkey", "o_orderstatus", "side")


@query("class_split_within_day", "with " + SPLIT.format(keys="o_orderstatus, o_orderpriority"))
def class_split_within(spark, sf):
    out = sampling.class_split(orders(spark, sf), ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority", "side")


@query("group_holdout", """with b as (
  select o_orderkey, case when o_orderstatus = 'F' then 'F' else 'OP' end as cls,
         case when o_orderstatus = 'F' then 'only' else o_orderpriority end as grp from orders),
g as (select distinct cls, grp, sha256('42:' || grp) as h from b),
r as (select *, row_number() over (partition by cls order by h) as rk, count(*) over (partition by cls) as groups from g),
p as (select b.*, row_number() over (partition by cls order by o_orderkey) - 1 as at from b)
select p.o_orderkey, p.cls, p.grp,
 case when r.groups = 1 then case when p.at % 3 = 2 then 'test' else 'train' end
      when r.rk <= greatest(1, least(r.groups - 1, round_even(r.groups * cast(0.67 as double), 0))) then 'train' else 'test' end as side,
 case when r.groups = 1 then 'stride_within_group' else 'group_holdout' end as strategy
from p join r on r.cls = p.cls and r.grp = p.grp""")
def group_holdout(spark, sf):
    o = orders(spark, sf)
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "F").otherwise("OP").alias("cls"),
                    F.when(F.col("o_orderstatus") == "F", "only").otherwise(F.col("o_orderpriority")).alias("grp"))
    return sampling.group_holdout(rows, "cls", "grp", ["o_orderkey"]).select("o_orderkey", "cls", "grp", "side", "strategy")


@query("leave_one_out", """select a.o_orderpriority as test_fold, b.o_orderpriority as train_fold
from (select distinct o_orderpriority from orders) a join (select distinct o_orderpriority from orders) b
  on a.o_orderpriority <> b.o_orderpriority""")
def leave_one_out(spark, sf):
    return sampling.leave_one_out(orders(spark, sf), "o_orderpriority")


@query("balance_down", """with c as (select o_orderkey, case when o_orderpriority = '5-LOW' then 'low' else 'rest' end as cls from orders),
n as (select *, row_number() over (partition by cls order by o_orderkey) - 1 as position, count(*) over (partition by cls) as size from c),
t as (select min(size) as target from n),
picks as (select distinct cls, least(size - 1, cast(floor(i * (cast(size as double) / target)) as bigint)) as position
          from (select distinct cls, size from n), t, lateral (select unnest(range(0, target)) as i))
select n.o_orderkey, n.cls from n join picks p on p.cls = n.cls and p.position = n.position""")
def balance_down(spark, sf):
    o = orders(spark, sf)
    rows = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("rest").alias("cls"))
    return sampling.balance_down(rows, "cls", ["o_orderkey"]).select("o_orderkey", "cls")


@query("window_quota", """select o_orderkey, o_orderstatus, o_orderpriority from (
 select *, row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) as rn from orders) where rn <= 20""")
def window_quota(spark, sf):
    return sampling.quota(orders(spark, sf), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 20)


@query("label_census", "select o_orderpriority, count(*) as n from orders group by 1 order by n desc, 1 limit 3")
def label_census(spark, sf):
    return sampling.census(orders(spark, sf), "o_orderpriority", 3)


DAILY = f"{FLOW}, d as (select *, ts_us // {DAY} as day, case when dst = 'error' then 'flood' else 'benign' end as label from flow)"


def daily(spark, sf):
    f = flow(spark, sf)
    return f.withColumn("day", F.floor(F.col("ts_us") / DAY).cast("bigint")).withColumn(
        "label", F.when(F.col("dst") == "error", "flood").otherwise("benign"))


@query("support_gate", f"""with {DAILY}, c as (select day, count(*) filter (label = 'flood') as n_flood,
 count(*) filter (label = 'benign') as n_benign from d group by day)
select *, n_flood >= 65 and n_benign >= 65 as usable from c""")
def support_gate(spark, sf):
    return sampling.support_gate(daily(spark, sf), "day", "label", ["flood", "benign"], 65)


@query("replay_clock", f"""with {DAILY} select seq, label,
 1000000 + (row_number() over (partition by label order by src, seq) - 1) * 20000 as ts_us from d""")
def replay_clock(spark, sf):
    out = sampling.replay_clock(daily(spark, sf).drop("ts_us"), ["src", "seq"], 1_000_000, 20_000, ["label"])
    return out.select("seq", "label", "ts_us")


# --- label quality ---

VECTORS = """v as (select d.doc_id as seq, sha256(concat_ws(chr(31), d.lang, d.source, cast(d.n_chars // 500 as varchar))) as key,
  case when l.quality = 1 then 'normal' else 'probe' end as category
  from documents d join labels l on l.doc_id = d.doc_id),
c as (select key, category, count(*) as n from v group by all),
k as (select key, cast(sum(n) as bigint) as rows, count(*) as classes, max(n) as majority from c group by key)"""


def vectors(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 500).alias("size"))
    joined = docs.join(table(spark, sf, "labels"), "doc_id")
    return joined.select(F.col("doc_id").alias("seq"), quality.vector_key(["lang", "source", "size"]).alias("key"),
                         F.when(F.col("quality") == 1, "normal").otherwise("probe").alias("category"))


@query("label_quality", f"""with {VECTORS} select cast(sum(rows) as bigint) as rows, count(*) as distinct_vectors,
 round(1 - count(*) / sum(rows), 6) as duplicate_row_fraction, count(*) filter (classes > 1) as ambiguous_vectors,
 coalesce(cast(sum(rows) filter (classes > 1) as bigint), 0) as rows_in_ambiguous_vectors,
 round(coalesce(sum(rows) filter (classes > 1), 0) / sum(rows), 6) as ambiguous_row_fraction,
 round(sum(majority) / sum(rows), 6) as deterministic_ceiling from k""")
def label_quality(spark, sf):
    return rounded(quality.label_quality(vectors(spark, sf)), "duplicate_row_fraction", "ambiguous_row_fraction",
                   "deterministic_ceiling")


@query("label_quality_by_class", f"""with {VECTORS} select c.category, cast(sum(n) as bigint) as rows, count(*) as distinct_vectors,
 round(coalesce(sum(n) filter (classes > 1), 0) / sum(n), 6) as ambiguous_row_fraction,
 cast(sum(n) - coalesce(sum(n) filter (classes > 1), 0) as bigint) as rows_after_guard,
 count(*) filter (classes = 1) as vectors_after_guard from c join k on k.key = c.key group by c.category""")
def label_quality_by_class(spark, sf):
    return rounded(quality.label_quality_by_class(vectors(spark, sf)), "ambiguous_row_fraction")


@query("ambiguous_vectors", f"with {VECTORS} select * from k where classes > 1")
def ambiguous_vectors(spark, sf):
    return quality.ambiguous_vectors(vectors(spark, sf))


@query("unambiguous_rows", f"with {VECTORS} select v.* from v where key not in (select key from k where classes > 1)")
def unambiguous_rows(spark, sf):
    return quality.drop_ambiguous(vectors(spark, sf))


@query("deduped_vectors", f"""with {VECTORS} select seq, key, category from (
 select *, row_number() over (partition by key order by seq) as rn from v) where rn = 1""")
def deduped_vectors(spark, sf):
    return quality.dedupe_first(vectors(spark, sf)).select("seq", "key", "category")


@query("label_ceiling", f"""with {VECTORS} select cast(sum(rows) as bigint) as rows, cast(sum(majority) as bigint) as majority_rows,
 round(sum(majority) / sum(rows), 6) as ceiling from k""")
def label_ceiling(spark, sf):
    return rounded(quality.label_ceiling(vectors(spark, sf)), "ceiling")


@query("vector_checksums", """select doc_id, sha256(concat_ws(chr(31), lang, source, cast(n_chars as varchar))) as exact_key from documents""")
def vector_checksums(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", quality.vector_key(["lang", "source", "n_chars"]).alias("exact_key"))


@query("category_counts", f"with {VECTORS} select category, count(*) as n from v group by 1")
def category_counts(spark, sf):
    return quality.category_counts(vectors(spark, sf))


# --- hosts ---

HOSTS = f"{DAILY}, h as (select src, bool_or(label = 'flood') as a, bool_or(label = 'benign' and port < 20) as b from d group by src)"


def hosts(spark, sf):
    return daily(spark, sf).withColumn("label", F.when(F.col("label") == "flood", "flood").when(
        F.col("port") < 20, "benign").otherwise("other"))


@query("host_overlap", f"""with {HOSTS} select count(*) filter (a) as attack_hosts, count(*) filter (b) as benign_hosts,
 count(*) filter (a and b) as shared_hosts,
 (select string_agg(src, ',' order by src) from (select src from h where a and b order by src limit 10)) as first_shared from h""")
def host_overlap(spark, sf):
    return quality.host_overlap(hosts(spark, sf), "src")


@query("contaminated_drop", f"""with {DAILY}, a as (select distinct day, src from d where label = 'flood')
select seq, day, src, label from d where not (label = 'benign' and exists (select 1 from a where a.day = d.day and a.src = d.src))""")
def contaminated_drop(spark, sf):
    return quality.drop_contaminated(daily(spark, sf).select("seq", "day", "src", "label"), ["day"], "src")


@query("contaminated_counts", f"""with {DAILY}, h as (select day, src, bool_or(label = 'flood') as a, bool_or(label = 'benign') as b,
 count(*) filter (label = 'benign') as n from d group by all)
select day, count(*) filter (a) as attack_hosts, count(*) filter (b) as benign_hosts, count(*) filter (a and b) as shared_hosts,
 coalesce(cast(sum(n) filter (a and b) as bigint), 0) as benign_rows_dropped from h group by day""")
def contaminated_counts(spark, sf):
    return quality.contaminated_counts(daily(spark, sf), ["day"], "src")


@query("day_survey", f"""with {DAILY} select day, count(*) as rows, count(*) filter (label = 'flood') as attack_rows,
 count(*) filter (label = 'benign') as benign_rows, round(count(*) filter (label = 'benign') / count(*), 6) as benign_fraction,
 round((max(ts_us) - min(ts_us)) / 3.6e9, 6) as span_hours, min(ts_us) as first_us, max(ts_us) as last_us from d group by day""")
def day_survey(spark, sf):
    return rounded(quality.survey(daily(spark, sf), ["day"]), "benign_fraction", "span_hours")


@query("source_concentration", f"""with {DAILY}, p as (select label, src, count(*) as n from d group by all)
select label, count(*) as sources, round(sum(n) / count(*), 6) as rows_per_source, round(max(n) / sum(n), 6) as top_share from p group by label""")
def source_concentration(spark, sf):
    return rounded(quality.source_concentration(daily(spark, sf), ["label"], "src"), "rows_per_source", "top_share")


# --- set operations ---

@query("shared_hosts", f"with {DAILY} select src from d where label = 'flood' intersect select src from d where label = 'benign' and port < 20")
def shared_hosts(spark, sf):
    d = hosts(spark, sf)
    return d.filter(F.col("label") == "flood").select("src").intersect(d.filter(F.col("label") == "benign").select("src"))


@query("never_attacking_hosts", f"with {DAILY} select src from d where port < 20 except select src from d where label = 'flood' and port > 80")
def never_attacking_hosts(spark, sf):
    d = daily(spark, sf)
    return d.filter(F.col("port") < 20).select("src").subtract(
        d.filter((F.col("label") == "flood") & (F.col("port") > 80)).select("src"))


@query("host_universe", f"with {FLOW} select cast(src as varchar) as host from flow union select dst from flow")
def host_universe(spark, sf):
    f = flow(spark, sf)
    return f.select(F.col("src").cast("string").alias("host")).union(f.select("dst")).distinct()


@query("split_leak", """with h as (select o_orderkey, o_custkey, sha256('42:' || o_orderkey) as h from orders),
s as (select *, row_number() over (order by h) - 1 as rk, count(*) over () as size from h)
select count(*) as shared_customers from (
 select o_custkey from s where rk < floor(size * cast(0.67 as double)) intersect
 select o_custkey from s where rk >= floor(size * cast(0.67 as double)))""")
def split_leak(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("all", F.lit("all"))
    s = sampling.class_split(rows, ["all"], "o_orderkey")
    shared = s.filter("side = 'train'").select("o_custkey").intersect(s.filter("side = 'test'").select("o_custkey"))
    return shared.agg(F.count(F.lit(1)).alias("shared_customers"))


