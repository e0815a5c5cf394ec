"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

#: Five-word shingles of a table's texts, each once: (id, s).
_SHINGLES = """select distinct {id} as id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from (select {id}, {words} as w from {table})"""

OP5 = f"""
with d as ({_SHINGLES.format(id="doc_id", table="documents", words=_WORDS)}),
b as ({_SHINGLES.format(id="item_id", table="benchmark", words=_WORDS)}),
n as (select id, count(*) as q from b group by id)
select d.id as doc_id, b.id as item_id, count(*)::bigint as shared, any_value(q)::bigint as item_shingles
from d join b using (s) join n on n.id = b.id
group by d.id, b.id having count(*) >= ceil(0.8 * any_value(q) - 1e-9)
"""

OP1 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from p qualify rank <= 20
"""

_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRET_COUNTS = f"""
select doc_id, len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda v: length(v) >= 6))::bigint as n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::bigint as n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 24))::bigint as n_hex
from (select doc_id, coalesce(text, '') as t from documents)
"""

#: crc32 of the decimal text of doc_id, bit by bit.
_BIT = "lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end"
_BYTE = f"lambda c, x: list_reduce(list_concat([xor(c, x)], list_transform(range(8), lambda i: i::ubigint)), {_BIT})"
_CRC = f"xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)), {_BYTE}), 4294967295::ubigint)"

LM_BASE = f"""
with d as (select doc_id, {_CRC} % 5 = 1 as held_out, list_concat({_WORDS}, [chr(10)]) as w from documents),
t as (select doc_id, held_out, unnest(w) as word from d),
u as (select word, count(*) as c from t where not held_out group by word),
s as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from u)
select doc_id, held_out, count(*)::bigint as n_tokens, count(c)::bigint as n_known, (select n from s) as train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.5) / ((select n from s) + 0.5 * ((select v from s) + 1)))), 6) as base_score
from t left join u using (word) group by doc_id, held_out
"""

#: Every order is applied to the cells, and the Shapley sums come from all 120 results.
FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as least from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select w.doc_id, part, coalesce(good, 0) as good, coalesce(l.toxic, 0) as toxic,
    coalesce((len(words) < 200)::int, 0) + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce((w.doc_id > least)::int, 0) as mask
  from w left join l on l.doc_id = w.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
  where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, i as step, substr(filter_order, i, 1) as letter, f.bit,
    coalesce((select sum(g.bit) from f g where contains(substr(filter_order, 1, i - 1), g.x)), 0)::bigint as gone
  from o, range(1, 6) r(i), f where f.x = substr(filter_order, i, 1)),
r as (select part, filter_order, step, letter,
    sum(n) filter (mask & (gone | bit) = 0) as kept, sum(n) filter (mask & bit <> 0 and mask & gone = 0) as removed,
    sum(n) filter (mask & bit <> 0 and mask & gone <> 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
    sum(good) filter (mask & bit <> 0 and mask & gone = 0) as good_lost, sum(toxic) filter (mask & bit <> 0 and mask & gone = 0) as toxic_lost
  from cells, s group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, letter)::bigint as shapley from r
"""

ORACLES: dict[str, str] = {
    "op1_top_k": OP1,
    "op5_decontamination": OP5,
    "op13_filter_audit": FILTER_AUDIT,
    "secret_counts": SECRET_COUNTS,
    "lm_base_scores": LM_BASE,
}
