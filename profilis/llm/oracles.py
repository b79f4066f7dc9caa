"""SQL that gives the rows of those queries which SQL can express."""

OP7_CHAT = r"""
with t as (
  select conv_id, coalesce(turn, 0) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(replace(replace(replace(text, '\', '\e'), '</turn>', '\t'), '###', '\h')) as text_chars,
    length(replace(replace(replace(replace(role, '\', '\e'), '</turn>', '\t'), '###', '\h'), chr(10), '\n')) as role_chars
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + role_chars + 2 + text_chars + 8) as bigint) as formatted_chars
from e group by conv_id
"""

OP8_TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

OP5_MINHASH = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ') else array_to_string(words[i : i + 4], ' ') end as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)
), n as (
  select w.doc_id, count(s.shingle) as n from w left join s using (doc_id) group by w.doc_id
), c as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), l as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)
), e as (select a, b from l union all select b, a from l), r as (
  select doc_id as id, doc_id as low from n union select e.b, r.low from r join e on e.a = r.id where r.low < e.b
), m as (select id, min(low) as low from r group by id)
select n.doc_id, n.n as n_shingles, m.low as component_id, n.doc_id = m.low as kept from n join m on m.id = n.doc_id
"""

ORACLES: dict[str, str] = {"op5_minhash": OP5_MINHASH, "op7_chat": OP7_CHAT, "op8_topk": OP8_TOPK}
