"""DuckDB SQL with the same rows, for the operators that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = """
with p as (select page_id, coalesce(html, '') as t from pages),
q as (select page_id, t, strlen(t) as n, max(page_id) over (partition by t) as best from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(t) as payload_digest,
  case when n >= 1000 and best <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and best <> page_id then best end as refers_to, true as digest_ok
from q
"""


def reached(links: str, nodes: str) -> str:
    """Rows (id, component): the smallest id reachable over links (a, b), both ways."""
    return f"""select id, min(r) as component from (with recursive reach as (select id, id as r from ({nodes}) union select reach.id, l.b from reach join ({links}) l on l.a = reach.r) select * from reach) group by id"""


OP8 = f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where label is not null),
l as (select x.vec_id as a, y.vec_id as b from e x join e y on x.label = y.label and x.vec_id <> y.vec_id where list_cosine_similarity(x.v, y.v) >= 0.93),
c as ({reached("select * from l", "select vec_id as id from embeddings")})
select vec_id, (select count(*) from l where a = vec_id) as n_links, component as component_id, vec_id = component as kept from embeddings join c on id = vec_id
"""

OP10 = f"""
with w as (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
s as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, unnest(s) as h from s),
p as (select x.doc_id as a, y.doc_id as b, count(*) as n from e x join e y on x.h = y.h and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
c as ({reached("select * from l", "select doc_id as id from documents")})
select s.doc_id, cast(len(s) as bigint) as n_shingles, component as component_id, s.doc_id = component as kept from s join c on c.id = s.doc_id
"""


def _deal(name: str, children: str, parent: list[str], head: list[str]) -> str:
    """A named subquery that gives children (head, node, weight, capacity, total) their budget."""
    by = f"partition by {', '.join(parent)}" if parent else ""
    over = f"{by} order by (case when weight > 0 then capacity / weight else 0 end), node"
    cols = ", ".join(head)
    return f"""
{name}_a as (select *, coalesce(sum(case when weight > 0 then capacity else 0 end) over ({over} rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over ({over} rows between current row and unbounded following) as weight_left from ({children})),
{name}_b as (select *, case when weight > 0 then greatest(total - before, 0) / weight_left else 0 end as own from {name}_a),
{name}_c as (select *, weight > 0 and capacity <= own * weight as is_full from {name}_b),
{name}_d as (select *, arg_min(own, before) filter (weight > 0 and not is_full) over ({by}) as level from {name}_c),
{name} as (select {cols}, case when weight <= 0 then 0 when is_full then capacity else least(capacity, level * weight) end as budget from {name}_d)"""


def op3(weights: dict[tuple[str, ...], float], share: float, epochs: int, seed: int) -> str:
    def values(depth: int) -> str:
        cols = ["domain", "lang", "source"][:depth]
        rows = [k for k in weights if len(k) == depth]
        if not rows:
            return "select null as domain, null as lang, null as source, null as w where false"
        return f"select * from (values {', '.join('(' + ', '.join([repr(x) for x in k]) + f', {weights[k]}::double)' for k in rows)}) t({', '.join(cols)}, w)"

    parts = []
    total = "(select {share} * sum(tokens) from leaves)".format(share=repr(float(share)))
    for depth, (name, cols) in enumerate((("l1", ["domain"]), ("l2", ["domain", "lang"]), ("l3", ["domain", "lang", "source"])), 1):
        head, parent = ", ".join(f"x.{c}" for c in cols), cols[:-1]
        above = total if depth == 1 else "max(u.budget)"
        on = " and ".join(f"x.{c} = v.{c}" for c in cols)
        up = "" if depth == 1 else f" join l{depth - 1} u on " + " and ".join(f"x.{c} = u.{c}" for c in parent)
        children = f"select {head}, any_value(x.{cols[-1]}) as node, any_value(coalesce(v.w, 1.0))::double as weight, sum(x.tokens * {epochs})::double as capacity, {above}::double as total from leaves x left join ({values(depth)}) v on {on}{up} group by {head}"
        parts.append(_deal(name, children, parent, cols))
    return f"""
with n as (select regexp_extract(source, '^src([0-9]{{1,9}})$', 1) as n, * exclude (n_chars) from documents),
rows_ as (select doc_id, case when try_cast(n as bigint) < 5 then 'web' when try_cast(n as bigint) < 10 then 'news' when try_cast(n as bigint) < 15 then 'books' when try_cast(n as bigint) >= 15 then 'code' else 'other' end as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, cast(coalesce(len({WORDS.format("text")}), 0) as bigint) as n_tokens from n),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from rows_ group by all),
{", ".join(parts)},
b as (select domain, lang, source, tokens, round(budget, 6) as leaf_budget, case when tokens > 0 then cast(floor(round(budget, 6) / tokens) as bigint) else 0 end as epochs from leaves join l3 using (domain, lang, source)),
p as (select *, leaf_budget - epochs * tokens as rest, cast('0x' || substr(md5('{seed}|' || epochs || '|' || coalesce(doc_id::varchar, '')), 1, 12) as bigint) as place from rows_ join b using (domain, lang, source)),
t as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place range between unbounded preceding and 1 preceding), 0) as before from p)
select doc_id, domain, lang, source, n_tokens, tokens as leaf_tokens, leaf_budget, epochs + (before < rest)::bigint as copies from t
"""
