"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontaminate, embeddings, html, langid, merkle, minhash, pii, quality, substrings, suffixes, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_embedding_dedup": embeddings.op2_embedding_dedup,
    "op3_minhash": minhash.op3_minhash,
    "op4_html_text": html.op4_html_text,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_pii": pii.op7_pii,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_word_bpe": wordbpe.op11_word_bpe,
    "op12_centroids": centroids.op12_centroids,
    "op13_merkle": merkle.op13_merkle,
}

_REACHED = """select node, min(other) as component_id from reached group by 1"""
_WORDS = "regexp_extract_all({text}, '[^ \\t-\\r]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Written for small tables: links are all pairs, components are reached step by step. The others have no SQL: their
#: methods learn or search what SQL cannot express, and tests/llm holds them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """with recursive
        v as (select vec_id, label, e from (select vec_id, label, embedding::double[] as e from embeddings) where label is not null and e is not null
            and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
        links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
        reached(node, other) as (select vec_id, vec_id from embeddings union select r.node, l.b from reached r join links l on l.a = r.other),
        least as (""" + _REACHED + """)
        select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
        from embeddings left join (select a as vec_id, count(*) as n from links group by 1) using (vec_id) join least on node = vec_id""",
    "op3_minhash": f"""with recursive
        worded as (select doc_id, {_WORDS.format(text=_LOWER)} as w from documents),
        sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from worded),
        items as (select doc_id, len(s) as n, unnest(s) as item from sets),
        links as (select a.doc_id as a, b.doc_id as b from items a join items b on a.item = b.item and a.doc_id <> b.doc_id group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reached(node, other) as (select doc_id, doc_id from documents union select r.node, l.b from reached r join links l on l.a = r.other),
        least as ({_REACHED})
        select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join least on node = doc_id""",
    "op5_substring_dedup": f"""with worded as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
        placed as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, unnest(list_transform(range(1, len(w) + 1), lambda i: case when i + 12 <= len(w) then array_to_string(w[i : i + 12], ' ') end)) as win from worded),
        flagged as (select doc_id, i, word, win is not null and min(doc_id) over (partition by win) < doc_id as later from placed),
        judged as (select doc_id, i, word, bool_or(later) over (partition by doc_id order by i rows between 12 preceding and current row) as gone from flagged)
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from worded left join
        (select doc_id, count(*) filter (gone) as n, string_agg(word, ' ' order by i) filter (not gone) as kept from judged group by 1) using (doc_id)""",
    "op9_suffix_dedup": """with bytes as (select doc_id, encode(coalesce(text, '')) as b from documents),
        placed as (select doc_id, unnest(range(1, octet_length(b) + 1)) as i, unnest(list_transform(range(1, octet_length(b) + 1), lambda i: hex(b[i : i]))) as digits,
            unnest(list_transform(range(1, octet_length(b) + 1), lambda i: case when i + 199 <= octet_length(b) then md5(b[i : i + 199]) end)) as s from bytes),
        flagged as (select doc_id, i, digits, s is not null and count(*) over (partition by s) > 1 as again from placed),
        judged as (select doc_id, i, digits, bool_or(again) over (partition by doc_id order by i rows between 199 preceding and current row) as gone from flagged),
        edged as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as new from judged)
        select doc_id, octet_length(b) as n_bytes, coalesce(n, 0) as n_removed, coalesce(m, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from bytes left join
        (select doc_id, count(*) filter (gone) as n, count(*) filter (new) as m, string_agg(digits, '' order by i) filter (not gone) as kept from edged group by 1) using (doc_id)""",
    "op12_centroids": centroids.SQL,
    "op13_merkle": merkle.SQL,
}
