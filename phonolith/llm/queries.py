"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phonolith.llm.common import table
from phonolith.llm.conversations import repair_damaged
from phonolith.llm.decontaminate import contaminated
from phonolith.llm.exact_dedup import exact_dedup
from phonolith.llm.language import identify
from phonolith.llm.licenses import license_scan
from phonolith.llm.mixing import mix
from phonolith.llm.near_dedup import near_dedup
from phonolith.llm.neighbours import nearest
from phonolith.llm.periodic_runs import find_runs, run_digests, with_loops
from phonolith.llm.pii import digest_columns, personal_data
from phonolith.llm.quality import quality
from phonolith.llm.toxicity import toxicity
from phonolith.llm.url_filter import filter_urls


def op2(spark: SparkSession, d: str) -> DataFrame:
    return contaminated(spark, table(spark, d, "documents"), table(spark, d, "benchmark")).drop("text_key")


QUERIES = {
    "op1_source_mix": lambda spark, d: mix(spark, table(spark, d, "documents"))[0].drop("source"),
    "op2_decontaminate": op2,
    "op3_personal_data": lambda spark, d: digest_columns(personal_data(table(spark, d, "documents"))),
    "op4_language_id": lambda spark, d: identify(spark, table(spark, d, "documents")),
    "op5_minhash_near_dedup": lambda spark, d: near_dedup(spark, table(spark, d, "documents")).drop("text_key"),
    "op6_url_filter": lambda spark, d: filter_urls(spark, table(spark, d, "pages")),
    "op7_exact_dedup": lambda spark, d: exact_dedup(spark, table(spark, d, "documents")),
    "op8_quality": lambda spark, d: quality(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_toxicity": lambda spark, d: toxicity(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_license_scan": lambda spark, d: license_scan(table(spark, d, "documents")),
    "op11_conversation_repair": lambda spark, d: repair_damaged(spark, table(spark, d, "conversations")),
    "op12_periodic_runs": lambda spark, d: run_digests(find_runs(with_loops(table(spark, d, "documents")))),
    "op13_nearest_neighbours": lambda spark, d: nearest(spark, table(spark, d, "embeddings"), "vec_id % 20 = 0"),
}

SQL = {
    "op1_source_mix": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint size, row_number() over (order by encode(source) nulls last) - 1 i from d group by source),
w as (select *, 1 + i % 3 w, sum(size) over () total, sum(1 + i % 3) over () all_w from s),
r as (select *, row_number() over (order by size * 6 // w, i) k from w),
c as (select *, total - 3 * coalesce(sum(size) over (order by k rows between unbounded preceding and 1 preceding), 0) rest,
  all_w - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) rest_w from r),
f as (select min(k) k0 from c where rest * w <= 3 * size * rest_w),
t as (select source, size source_size, case when c.k < f.k0 then 3.0 * size
  else (max(rest) filter (c.k = f.k0) over () * w)::double / (max(rest_w) filter (c.k = f.k0) over ())::double end::double target from c, f),
o as (select doc_id, d.size, source_size, target, floor(target + 0.5)::bigint words,
  sum(d.size) over (partition by d.source order by md5('mix:' || coalesce(doc_id::varchar, '')), doc_id, d.size
    rows between unbounded preceding and current row) - d.size start
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size))
   + greatest(0, least(size, words - start - 2 * source_size)))::bigint taken
from o
""",
    "op2_decontaminate": r"""
with w as (
  select 'd' kind, doc_id id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark),
s as (
  select distinct kind, id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) shingle from w),
n as (select id, count(*) n from s where kind = 'i' group by 1)
select d.id doc_id, i.id item_id, n.n n_item, count(*) n_shared, count(*)::double / n.n::double containment
from s d join s i on d.shingle = i.shingle and d.kind = 'd' and i.kind = 'i' join n on n.id = i.id
group by d.id, i.id, n.n having 100 * count(*) >= 75 * n.n
""",
    "op5_minhash_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select distinct doc_id, shingle from (
    select doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) shingle from w)),
n as (select doc_id, count(*) n from s group by 1),
p as (
  select a.doc_id x, b.doc_id y, count(*) both_n from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * both_n >= 75 * (a.n + b.n - both_n)),
g as (select x, y from e union select y, x from e),
r(node, reach) as (select x, x from g union select r.node, g.y from r join g on g.x = r.reach),
c as (select node, min(reach) component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.component_id, d.doc_id) component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) kept
from documents d left join n using (doc_id) left join c on c.node = d.doc_id
""",
    "op7_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256, length(coalesce(text, '')) n from documents)
select doc_id, first_value(doc_id) over k keep_id, count(*) over (partition by text_sha256) group_size,
  doc_id = first_value(doc_id) over k kept, text_sha256
from t window k as (partition by text_sha256 order by n desc, doc_id)
""",
}
