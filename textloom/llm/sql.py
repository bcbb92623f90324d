"""SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_LEMMAS = r"""
last_run as (select source_doc_id, arg_max(content_morphosyntax, (tagged_at, tagged_id)) as m from tagged_docs where source_doc_id is not null group by 1),
n_docs as (select count(*) as n from last_run),
lemma_tokens as (select source_doc_id, unnest(m, max_depth := 1) as t from last_run),
lemmas as (
  select lower(trim(t.lemma)) as term, count(*) as occurrences, count(distinct source_doc_id) as records, bool_or(coalesce(t.is_oov, false)) as oov
  from lemma_tokens where coalesce(t.pos, '') not in ('NUM', 'PUNCT') and trim(coalesce(t.lemma, '')) <> '' group by 1),
names as (
  select triple_type as origin, batch_id, trim(lower(regexp_replace(sentence, '#{2,}\s*[A-Za-z]+\s*#{2,}', '', 'g'))) as term, arg_min(coalesce("count", 0), relation_id) as c
  from relation_names where triple_type is not null and sentence is not null group by 1, 2, 3),
name_counts as (select origin, term, count(*) as occurrences, cast(sum(c) as bigint) as total from names where term <> '' group by 1, 2),
marked as (
  select 'lemma' as origin, term, occurrences, records, occurrences as total,
    case when records * 5 > n then 'common' when records < 3 and oov then 'rare_oov' when records < 3 then 'rare' end as mark
  from lemmas, n_docs
  union all
  select origin, term, occurrences, occurrences, total, case when total <= 2 then 'rare' when total >= 5000 then 'common' end from name_counts)
"""

_FIELD = "regexp_replace(lower(coalesce(case when json_type(j, '{0}') = 'ARRAY' then array_to_string(cast(json_extract(j, '{0}') as varchar[]), '') else json_extract_string(j, '{0}') end, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_FIELDS = " || chr(1) || ".join(_FIELD.format(f"$.{p}.{k}") for p in ("subject", "property", "value") for k in ("content", "lemma_content"))
_COPIES = f"""
parsed as (select kg_id, cast(kg as json) as j from kg_lines where json_valid(kg)),
keyed as (select kg_id, {_FIELDS} as k from parsed),
kept as (select kg_id, min(kg_id) over (partition by k) as kept_id from keyed)
"""

_PASSAGES = r"""
item_words as (select qid, regexp_extract_all(lower(description), '[\p{L}\p{N}]+') as w from eval_queries),
item_grams as (select distinct qid, array_to_string(w[i:i + 12], ' ') as g from (select qid, w, unnest(range(1, len(w) - 11)) as i from item_words)),
doc_words as (select doc_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') as w from documents),
doc_grams as (select distinct doc_id, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from doc_words))
"""

#: Groups are cliques, so a row's first is the smallest row that reaches the threshold.
_VECTORS = """
usable as (select relation_id, triple_type, [cast(x as double) for x in embedding] as v from relation_names
  where triple_type is not null and len(embedding) = 64 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
unit as (select relation_id, triple_type, [x / sqrt(list_dot_product(v, v)) for x in v] as u from usable)
"""

_SEQUENCES = r"""
rec_words as (select record_id, regexp_extract_all(lower(array_to_string(content, ' ')), '[\p{L}\p{N}]+') as w from converted_docs),
seqs as (select distinct record_id, array_to_string(w[i:i + 2], ' ') as g from (select record_id, w, unnest(range(1, len(w) - 1)) as i from rec_words)),
sizes as (select record_id, count(*) as n from seqs group by 1),
shared as (select a.record_id as record_id_a, b.record_id as record_id_b, count(*) as c from seqs a join seqs b on a.g = b.g and a.record_id < b.record_id group by all)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"with {_VECTORS} select min(a.relation_id) as first_id, b.relation_id from unit a join unit b on a.triple_type = b.triple_type and list_dot_product(a.u, b.u) >= 0.8 group by b.relation_id having min(a.relation_id) < b.relation_id",
        "p4_found": f"with {_SEQUENCES} select record_id_a, record_id_b from shared join sizes x on x.record_id = record_id_a join sizes y on y.record_id = record_id_b where c / (x.n + y.n - c) >= 0.5",
        "p5_found": f"with {_LEMMAS} select origin, term, mark from marked where mark is not null",
        "p5_frequencies": f"with {_LEMMAS} select origin, term, occurrences, records, total, mark from marked",
        "p7_found": f"with {_COPIES} select kept_id, kg_id as copy_id from kept where kg_id > kept_id",
        "p7_collapsed": f"with {_COPIES} select kept_id, count(*) as n_copies from kept group by 1 union all select kg_id, 1 from kg_lines where not coalesce(json_valid(kg), false)",
        "p9_found": f"with {_PASSAGES} select distinct qid, doc_id from item_grams join doc_grams using (g)",
        "p9_clean_documents": f"with {_PASSAGES} select doc_id, source from documents where doc_id not in (select doc_id from item_grams join doc_grams using (g))",
    }
