"""DuckDB SQL of the operators that SQL expresses."""

from __future__ import annotations


def vector_codes(rounds: int = 4) -> str:
    """Plain Lloyd, round by round: every part against every entry."""
    steps = [
        """kept as materialized (select row_number() over (order by vec_id, x) - 1 as r, * from (
            select vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::double)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0))""",
        "parts as materialized (select r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)]::double[] as v from kept, range(4) t(p))",
        "b0 as materialized (select p, r as entry, v as c from parts where r < 256)",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (select r, p, min((list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::bigint * 256 + entry) as m
            from parts join b{k} using (p) group by all)""")
        if k < rounds:
            steps.append(f"""n{k} as materialized (select p, entry, list(f order by j) as c from (
                select p, m % 256 as entry, j, floor(sum(v[j]) / count(*)) as f from a{k} join parts using (r, p), generate_series(1, len(v)) t(j) group by all) group by all)""")
            steps.append(f"b{k + 1} as materialized (select b{k}.p, b{k}.entry, coalesce(n{k}.c, b{k}.c) as c from b{k} left join n{k} using (p, entry))")
    last = rounds
    steps.append(f"done as materialized (select r, string_agg(printf('%02x', (m % 256)::int), '' order by p) as code, sum(m // 256)::bigint as error from a{last} group by r)")
    steps.append(f"book as (select sha256(string_agg(c[j]::bigint::varchar, ',' order by p, entry, j)) as s from b{last}, generate_series(1, len(c)) t(j))")
    return f"""with {', '.join(steps)}
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select s from book) as codebooks_sha256 from kept join done using (r)"""


#: Fixed value: a term is a run of digits, ASCII letters and everything beyond ASCII.
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""with words as materialized (select row_number() over () as r, doc_id, {_TERMS} as terms from documents),
    total as (select count(*) as docs, sum(len(terms))::bigint as occurrences from words where len(terms) > 0),
    posting as materialized (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(terms) as n, unnest(terms) as term from words) group by all),
    weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from posting group by term), total),
    asked as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
    scored as (select item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // occurrences))))::bigint as score
        from asked join posting using (term) join weight using (term), total group by all)
    select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id, r) as rank from scored where score > 0) where rank <= 20"""
