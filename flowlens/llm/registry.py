"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import (
    dartminhash,
    decontam,
    license_scan,
    line_blocks,
    line_dedup,
    middle_frames,
    mixing,
    periodic_runs,
    pii_crf,
    quality_gam,
    substring_rlz,
    topk_nra,
    toxicity_knn,
)
from flowlens.llm.common import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op2_source_mix", r"""
with sized as (
  select doc_id, source, md5(text) as digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
totals as (select source, sum(size)::bigint as total from sized group by source),
weighed as (
  select source, total,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
         row_number() over (order by source nulls last) as place
  from totals),
run as (
  select *, sum(total) over w - total as before, sum(weight) over w - weight as wbefore,
         sum(total) over () as whole, sum(weight) over () as wall
  from weighed window w as (order by total / weight, place)),
levels as (
  select *, (whole - 3 * before)::double / (wall - wbefore)::double as level from run),
level as (select arg_min(level, row(total / weight, place)) as level from levels where 3 * (total / weight) >= level),
targets as (select source, total, least(total * 3.0::double, level.level * weight) as target from weighed, level),
rates as (
  select s.doc_id, s.digest, s.size, t.total, t.target,
         case when t.total > 0 then least(t.target / t.total, 3.0::double) else 0.0::double end as rate
  from sized s join targets t on s.source is not distinct from t.source),
copies as (
  select *, floor(rate)::bigint + (case when
      ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, 'null') || '|' || coalesce(digest, 'null')), 1, 13))::bigint / 4503599627370496.0::double
      < rate - floor(rate) then 1 else 0 end) as copies
  from rates)
select doc_id, size::bigint as size, total as source_size, round(target, 6) as target, (size * copies)::bigint as taken
from copies""")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op6_line_dedup", r"""
with lines as (
  select rowid as r, doc_id, source, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as i
  from (select *, row_number() over () as rowid from documents)),
pages as (select source, count(*) as pages from documents group by source),
bad as (
  select l.source, l.line from lines l join pages p on l.source is not distinct from p.source
  where trim(l.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' group by l.source, l.line, p.pages
  having count(distinct l.r) >= 5 and count(distinct l.r) > 0.02::double * p.pages),
kept as (
  select l.r, count(*) as n, count(b.line) as dropped,
         string_agg(l.line, chr(10) order by l.i) filter (where b.line is null) as text
  from lines l left join bad b on l.source is not distinct from b.source and l.line = b.line group by l.r)
select d.doc_id, d.lang, d.source, d.n_chars,
       case when d.text is null then null else coalesce(k.text, '') end as text,
       coalesce(k.n, 0)::bigint as n_lines, coalesce(k.dropped, 0)::bigint as n_dropped
from (select *, row_number() over () as rowid from documents) d left join kept k on d.rowid = k.r""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_gam.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                       table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op5_top_inner_products", r"""
with valid as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x) >= 4096)) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from valid q join valid c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5""")
def op5_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(table(spark, sf_dir, "embeddings"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_knn.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                         table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "near", "cosines")


_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{phrase}')" for i, (label, phrase) in enumerate(license_scan.TEMPLATES))


@query("op8_license_scan", r"""
with docs as (
  select row_number() over () as r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from documents),
words as (select r, doc_id, low, regexp_extract_all(low, '[0-9a-z\x{80}-\x{10FFFF}]+') as w from docs),
phrases(label, p) as (values ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']),
                             ('reserved', ['all', 'rights', 'reserved'])),
spots as (select r, w, unnest(range(len(w))) as i from words),
places as (select r, i, label from spots, phrases where list_extract(w, i + 1) = p[1] and w[i + 1 : i + len(p)] = p),
lines as (select r, regexp_extract_all(unnest(string_split(low, chr(10))), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from docs),
blocks as (
  select r, w as b from lines where len(w) <= 64
  union all
  select r, w[i + 1 : i + 64] from (select r, w, unnest(range(0, len(w) - 31, 32)) as i from lines where len(w) > 64)),
templates as (select id, label, list_distinct(string_split(phrase, ' ')) as t from (values TEMPLATE_ROWS) v(id, label, phrase)),
hits as (
  select r, label, len(list_intersect(t, b)) / len(t)::double as c from blocks, templates
  where list_has(b, 'licensed') or list_has(b, 'license') or list_has(b, 'software') or list_has(b, 'domain')
     or list_has(b, 'reserved') or list_has(b, 'modification')),
best as (select r, label, max(c) as c from hits where c >= 0.9 group by r, label)
select d.doc_id, len(w.w)::bigint as n_words, (select count(*) from places p where p.r = d.r)::bigint as n_base,
       (select min(i) from places p where p.r = d.r)::bigint as first_word,
       (select max(i) from places p where p.r = d.r)::bigint as last_word,
       coalesce((select string_agg(distinct label, ',' order by label) from places p where p.r = d.r), '') as base_labels,
       coalesce((select string_agg(distinct label, ',' order by label) from
         (select r, label from places union select r, label from best) a where a.r = d.r), '') as labels,
       case when exists (select 1 from places p where p.r = d.r) then 1.0::double
            else coalesce((select max(c) from best b where b.r = d.r), 0.0)::double end as score
from docs d join words w on d.r = w.r""".replace("TEMPLATE_ROWS", _TEMPLATE_ROWS))
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_decontamination", r"""
with docs as (
  select row_number() over () as r, * from (
    select distinct doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents)),
items as (
  select row_number() over () as k, * from (
    select distinct item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as iw from benchmark)
  where len(iw) > 0),
gram_items as (
  select k, len(iw) as l, least(5, len(iw)) as g, array_to_string(iw[i + 1 : i + least(5, len(iw))], ' ') as gram
  from (select *, unnest(range(len(iw) - least(5, len(iw)) + 1)) as i from items)),
spots as (
  select r, p, g, array_to_string(w[p + 1 : p + g], ' ') as gram
  from (select *, unnest(range(len(w) - g + 1)) as p from docs, (select distinct g from gram_items) where len(w) >= g)),
seeds as (select distinct r, k, l, g, p from spots join gram_items using (gram, g)),
starts as (
  select distinct s.r, w, k, l, unnest(range(greatest(p - l + g, 0), greatest(least(p, len(w) - l), 0) + 1)) as s
  from seeds s join docs using (r)),
cut as (select r, k, s, w[s + 1 : s + l] as v from starts),
bags as (
  select r, k, s, array_to_string(v[i + 1 : i + least(5, len(v))], ' ') as gram, count(*) as n
  from (select *, unnest(range(len(v) - least(5, len(v)) + 1)) as i from cut) group by all),
item_bags as (select k, gram, count(*) as n from gram_items group by all),
sizes as (select r, k, s, sum(n) as n from bags group by all),
item_sizes as (select k, sum(n) as n from item_bags group by all),
common as (
  select b.r, b.k, b.s, sum(least(b.n, i.n)) as c from bags b join item_bags i on b.k = i.k and b.gram = i.gram group by all),
sims as (
  select d.doc_id, t.item_id, c.r, c.k, c.s, c.c::double / (z.n + i.n - c.c)::double as sim
  from common c join sizes z using (r, k, s) join item_sizes i on c.k = i.k join docs d on c.r = d.r join items t on c.k = t.k)
select doc_id, item_id, arg_min(s, row(-sim, s))::bigint as first_word, max(sim) as similarity
from sims where sim >= 0.8 group by r, k, doc_id, item_id""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "first_word", "similarity")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup", r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
blocks as (
  select r, doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') as b
  from (select *, unnest(range(len(w) - 12)) as p from docs where len(w) >= 13 and doc_id is not null)),
firsts as (select b, min(doc_id) as src from blocks group by b),
gone as (
  select distinct r, unnest(range(p, p + 13)) as i from blocks join firsts using (b) where src < doc_id),
kept as (
  select d.r, count(g.i) as n, string_agg(d.word, ' ' order by d.i) filter (where g.i is null) as text
  from (select r, unnest(w) as word, unnest(range(len(w))) as i from docs) d
  left join gone g on d.r = g.r and d.i = g.i group by d.r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k on d.r = k.r""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_rlz.dedup_substrings(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(table(spark, sf_dir, "documents"))


@query("op11_html_text")
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract_text(table(spark, sf_dir, "pages"))


@query("op12_periodic_runs", r"""
with recursive steps(n, c, k) as (
  select range::bigint, range::bigint, 0 from range(256)
  union all
  select n, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc_table as (select list(c order by n) as t from steps where k = 8),
docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         coalesce(doc_id::varchar, '') as name from documents),
sums as (
  select r, doc_id, w, len(w)::bigint as n,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(name) + 1), lambda i: ord(name[i])::bigint)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from docs, crc_table),
drawn as (
  select *, h // 10 as g, case when h % 10 = 0 and n > 0 and doc_id is not null then (h // 10) % n end as a from sums),
places as (
  select r, doc_id, n, i, w[1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end] as word
  from (select *, unnest(range(n)) as i from drawn)),
same as (
  select x.r, y.i - x.i as q, x.i as i
  from places x join places y on x.r = y.r and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4),
islands as (
  select r, q, min(i) as s, count(*) + q as m
  from (select *, i - row_number() over (partition by r, q order by i) as island from same) group by r, q, island),
runs as (select r, s, m, min(q) as q from islands where m >= greatest(6, 4 * q) group by r, s, m),
best as (
  select r, count(*) as n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q) as listed,
         arg_min(row(s, m, q), row(-m::double / q::double, s, q)) as top
  from runs group by r),
gone as (select distinct r, unnest(range(s + q, s + m)) as i from runs),
kept as (
  select p.r, string_agg(p.word, ' ' order by p.i) as text from places p anti join gone g on p.r = g.r and p.i = g.i group by p.r)
select d.doc_id, d.n::bigint as n_words, coalesce(n_runs, 0)::bigint as n_runs, top[1]::bigint as start, top[2]::bigint as length,
       top[3]::bigint as period, (1000 * top[2] // top[3])::bigint as exponent_milli,
       sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from sums d left join best b on d.r = b.r left join kept k on d.r = k.r""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.with_repeating_tails(F.col("text"), F.col("doc_id")).alias("text")))


@query("op13_fill_in_middle", r"""
with docs as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
units as (
  select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, ('0x' || substr(h, 1, 8))::bigint as h1,
         ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 25, 8))::bigint as h4 from docs),
cuts as (
  select *, len(u)::bigint as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b
  from units),
parts as (
  select *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') as pre, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') as mid,
         coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') as suf,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from cuts)
select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars,
       case when form <> 'plain' then length(mid) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from parts""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_frames.fill_in_middle(table(spark, sf_dir, "documents"))
