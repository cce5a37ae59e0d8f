"""SQL (DuckDB) for the queries of training-data operators that SQL expresses.

XXH64, CRC-32 and the tokenizers have no SQL form, so op1, op8, op10, op11, op12 and the pipeline are tested against brute force instead."""

from __future__ import annotations

from sonolake.llm import licenses, mixing, quality, secrets

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"


def _q(s: str) -> str:
    return s.replace("'", "''")


QUALITY = f"""with d as (select doc_id, source, coalesce(text, '') as t, {_WORDS} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from d, unnest(range(1, len(w) - 3)) as u(i)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from c where c > 1),
r as (select doc_id, sum(case when p is null then 5 else least(5, i - p) end) as n_repeat_words from p group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as l from d), f as (select doc_id, count(*) - count(distinct l) as n from l where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
b as (select doc_id, source, t, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(f.n, 0)::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words from d left join f using (doc_id) left join r using (doc_id)),
s as (select doc_id, t, source, trim(regexp_replace(lower(l), '{_SPACE}', ' ', 'g'), ' ') as line, len(list_filter(string_split_regex(l, '{_SPACE}'), lambda x: x <> '')) as n from (select doc_id, t, source, unnest(string_split(t, chr(10))) as l from d)),
k as (select * from s where n > 0), h as (select source, count(distinct t) as docs from d group by source),
o as (select source, line from (select source, line, count(distinct t) as n from k group by source, line) join h using (source) where n > {quality.LIMITS.docs_floor} and (n > {quality.LIMITS.share}::double * docs or n > {quality.LIMITS.docs_most})),
x as (select k.doc_id, sum(n) as removed from k join o on k.source = o.source and k.line = o.line group by k.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and not (removed > 0 and (n_words - removed < {quality.LIMITS.left_words} or n_words - removed < {quality.LIMITS.left_share}::double * n_words)) as kept, removed as removed_words
from (select b.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as failed, coalesce(removed, 0)::bigint as removed from b left join x using (doc_id))"""


def _spans() -> str:
    """All spans as (doc_id, rank, kind, s, e): text between matches and matches, summed up."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.RULES):
        p = _q(pattern)
        parts.append(f"""select doc_id, {rank} as rank, '{kind}' as kind, s, s + length(m[i]) as e from (select doc_id, m, g, i, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
            from (select doc_id, string_split_regex(text, '{p}') as b, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {group}) as g from documents where text is not null and regexp_matches(text, '{p}')) a, unnest(range(1, len(m) + 1)) as u(i)) where length(g[i]) >= {least}""")
    return " union all ".join(parts)


SECRETS = f"""with s as ({_spans()}), a as (select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
    coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank) filter (where rank < {secrets.BASE}), '') as base, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank) as spans from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join a using (doc_id)"""

EMBEDDINGS = """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where label is not null),
ok as (select * from n where n > 0 and isfinite(n)), l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.n * b.n) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), c as (select a, min(b) as m from r group by a), k as (select a, count(*) as k from l group by a)
select vec_id, coalesce(k, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id <= coalesce(m, vec_id) as kept from embeddings left join c on c.a = vec_id left join k on k.a = vec_id"""

WORD_PASSAGES = f"""with d as (select doc_id, {_WORDS} as w from documents), x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from d, unnest(range(1, len(w) - 48)) as u(i)),
m as (select doc_id, i, min(doc_id) over (partition by h) as first from x), c as (select distinct doc_id, i + k as p from m, unnest(range(0, 50)) as u(k) where first < doc_id),
g as (select doc_id, count(*) as n, list(p) as ps from c group by doc_id), kept as (select d.doc_id, string_agg(w[p], ' ' order by p) as t from d, unnest(range(1, len(w) + 1)) as u(p) where not exists (select 1 from c where c.doc_id = d.doc_id and c.p = u.p) group by d.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join g using (doc_id) left join kept using (doc_id)"""

BYTE_PASSAGES = """with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents), n as (select *, length(x) // 2 as n from d),
w as (select r, i, md5(substr(x, 2 * i - 1, 400)) as h from n, unnest(range(1, n - 198)) as u(i)), m as (select r, i from (select r, i, count(*) over (partition by h) as c from w) where c > 1),
g as (select r, i, lag(i) over (partition by r order by i) as p from m), s as (select r, i, sum(case when p is null or i > p + 200 then 1 else 0 end) over (partition by r order by i) as k from g),
z as (select r, k, min(i) as a, max(i) + 200 as b from s group by r, k), o as (select *, lead(a) over (partition by r order by k) as nx, row_number() over (partition by r order by k) as f from z),
q as (select n.r, doc_id, n, coalesce(sum(b - a), 0)::bigint as gone, count(a) as spans, coalesce(string_agg(case when f = 1 then substr(x, 1, 2 * (a - 1)) else '' end || substr(x, 2 * b - 1, 2 * (coalesce(nx, n + 1) - b)), '' order by k), any_value(x)) as kept from n left join o on o.r = n.r group by n.r, doc_id, n)
select doc_id, n as n_bytes, gone as n_removed, spans as n_spans, sha256(unhex(kept)) as kept_sha256 from q"""


def _bisect(name: str, test: str) -> str:
    """A recursive table whose row STEPS has the bounds; where test holds at the middle, lo moves up."""
    z, t = "list_sum(list_transform(p, lambda x: pow(x, m)))", "list_sum(list_transform(p, lambda x: pow(x, m) * ln(x)))"
    moved = test.format(z=z, s=t, top="list_max(list_transform(p, lambda x: pow(x, m - 1)))")
    return f"{name}(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all select i + 1, case when ok then m else lo end, case when ok then hi else m end from (select *, {moved} as ok from (select b.*, (lo + hi) / 2 as m, p from {name} b, o where i < {mixing.STEPS})))"


_AT = "list_sum(list_transform(p, lambda x: pow(x, {a})))"
_ENTROPY = f"(ln({_AT}) - {{a}} / {_AT} * list_sum(list_transform(p, lambda x: pow(x, {{a}}) * ln(x))))"
_REPEAT = f"list_max(list_transform(p, lambda x: pow(x, {{a}} - 1))) / {_AT}"

MIXING = f"""with recursive c as (select doc_id, source, len({_WORDS})::bigint as tokens, coalesce(doc_id::varchar, 'null') as name, ('0x' || substr(md5('block|' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % {mixing.BLOCKS} as block from documents),
k as (select source, block, sum(tokens)::bigint as block_tokens from c group by source, block), t as (select source, sum(block_tokens)::bigint as st from k group by source having sum(block_tokens) > 0),
o as (select list(st / total::double order by st, source) as p, list(source order by st, source) as names, any_value(total)::bigint as total from t, (select sum(st) as total from t) x),
{_bisect('be', f"ln({{z}}) - m / {{z}} * {{s}} >= {mixing.ENTROPY_SHARE}::double * ln(len(p))")},
{_bisect('br', f"{{top}} / {{z}} * {mixing.BUDGET_SHARE}::double > {mixing.MAX_REPEAT}::double")},
e as (select p, names, total, round(greatest(case when {_ENTROPY.format(a='1.0::double')} >= {mixing.ENTROPY_SHARE}::double * ln(len(p)) then 1.0::double else (select lo from be where i = {mixing.STEPS}) end,
    case when {_REPEAT.format(a='0.0::double')} * {mixing.BUDGET_SHARE}::double <= {mixing.MAX_REPEAT}::double then 0.0::double else (select hi from br where i = {mixing.STEPS}) end), 6) as exponent from o),
w as (select names[i] as source, exponent, total, round(pow(p[i], exponent) / {_AT.format(a='exponent')}, 9) as weight from e, unnest(range(1, len(p) + 1)) as u(i)),
q as (select source, exponent, weight, floor(weight * total * {mixing.BUDGET_SHARE}::double)::bigint // st as full_, floor(weight * total * {mixing.BUDGET_SHARE}::double)::bigint % st as rest from w join t using (source)),
r as (select source, block, block_tokens, weight, exponent, full_, rest - coalesce(sum(block_tokens) over (partition by source order by md5(full_ || '|block|' || block), block rows between unbounded preceding and 1 preceding), 0) as room from k join q using (source)),
j as (select c.*, block_tokens, weight, exponent, full_, room, sum(tokens) over (partition by source, block order by md5(full_ || '|' || name), doc_id, tokens rows unbounded preceding) as run from c join r using (source, block)),
n as (select *, full_ + case when room > 0 and room < block_tokens then (run <= room)::int else (room >= greatest(block_tokens, 1))::int end as copies from j), x as (select *, epoch::int as ep from n, unnest(range(0, copies)) as u(epoch)),
y as (select source, block, epoch::int as ep, row_number() over (partition by source, epoch order by md5(epoch || '|block|' || block), block) - 1 as turn from r, unnest(range(0, full_ + 1)) as u(epoch))
select doc_id, source, tokens, ep as epoch, block, turn, md5(ep || '|block|' || block) as block_key, row_number() over (partition by source, block, ep order by md5(ep || '|' || name), doc_id, tokens) - 1 as place, weight, exponent from x join y using (source, block, ep)"""

_POSTINGS = ", ".join(f"('{w}', {t}, {q})" for w, t, q in licenses.postings())
_TEMPLATES = ", ".join(f"({t}, '{label}', ' {phrase} ', {len(words)})" for t, ((label, phrase, _), words) in enumerate(zip(licenses.TEMPLATES, licenses.template_words(), strict=True)))
_BASE = ", ".join(f"('{label}', {len(phrase.split())}, '{phrase}')" for phrase, label in licenses.BASE)

LICENSES = f"""with post(word, template, q) as (values {_POSTINGS}), tmpl(template, label, phrase, n) as (values {_TEMPLATES}), bases(label, n, phrase) as (values {_BASE}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') as w from documents), l as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as line from d),
b as (select doc_id, label, i - 1 as pos from l, bases, unnest(range(1, len(w) + 1)) as u(i) where contains(line, ' ' || phrase || ' ') and array_to_string(w[i:i + n - 1], ' ') = phrase),
bb as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels from b group by doc_id),
h as (select doc_id, i - 1 as p, w[i] as word from l, unnest(range(1, len(w) + 1)) as u(i) where w[i] in (select word from post)), hits as (select distinct doc_id, word from h),
rare as (select word, count(*) as df from hits group by word having count(*) <= {licenses.RARE_SHARE}::double * (select count(*) from documents) + {licenses.RARE_DOCS}), ok as (select doc_id from hits group by doc_id having count(*) >= {licenses.MIN_VOTES}),
looked as (select distinct doc_id, word from (select doc_id, hits.word, row_number() over (partition by doc_id, template order by df, hits.word) as rank from hits join rare using (word) join (select distinct word, template from post) k on k.word = hits.word where doc_id in (select doc_id from ok)) where rank <= {licenses.TOP_WORDS}),
ix as (select post.*, needed from post join (select template, least({licenses.MIN_VOTES}, count(distinct word)) as needed from post where word in (select word from rare) group by template) using (template) where word in (select word from rare)),
v as (select doc_id, template, p - q as shift, count(distinct word) as votes, any_value(needed) as needed from h join looked using (doc_id, word) join ix using (word) group by all),
best as (select doc_id, template, shift from (select *, row_number() over (partition by doc_id, template order by votes desc, shift) as r from v where votes >= needed) where r = 1),
c as (select best.doc_id, best.template, label, n, count(distinct post.q) as met from best join tmpl using (template) join l on l.doc_id = best.doc_id and contains(line, phrase) join post on post.template = best.template
    join h on h.doc_id = best.doc_id and h.word = post.word and h.p between best.shift + post.q - {licenses.SLACK} and best.shift + post.q + {licenses.SLACK} group by all),
f as (select doc_id, list(distinct label) filter (where met / n::double >= {licenses.MIN_COVERAGE}::double) as labels, max(met / n::double) as score from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(array_to_string(list_sort(bb.labels), ','), '') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(f.labels, [])))), ',') as labels, case when n_base > 0 then 1.0::double else coalesce(score, 0.0::double) end as score from d left join bb using (doc_id) left join f using (doc_id)"""

INTERACTIONS = f"""with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_WORDS} as w from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join l using (doc_id)),
c as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from f group by part, mask),
k(i, c) as (values (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
o as (select a.c || b.c || d.c || e.c || g.c as filter_order, [a.i, b.i, d.i, e.i, g.i] as ids from k a, k b, k d, k e, k g where len(list_distinct([a.i, b.i, d.i, e.i, g.i])) = 5),
s as (select filter_order, step::int as step, (1 << ids[step])::int as f, coalesce(list_sum(list_transform(ids[1:step - 1], lambda i: 1 << i)), 0)::int as before from o, unnest(range(1, 6)) as u(step)),
r as (select part, filter_order, step, f, sum(n) filter ((mask & (before | f)) = 0) as kept, sum(n) filter ((mask & f) > 0 and (mask & before) = 0) as removed, sum(n) filter ((mask & f) > 0 and (mask & before) > 0) as redundant,
    sum(n) filter (mask = f) as unique_fails, sum(g) filter ((mask & f) > 0 and (mask & before) = 0) as good_lost, sum(x) filter ((mask & f) > 0 and (mask & before) = 0) as toxic_lost from s, c group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, f), 0)::bigint as shapley from r"""

ORACLES = {"op2_quality": QUALITY, "op3_secrets": SECRETS, "op4_embeddings": EMBEDDINGS, "op5_fmindex": WORD_PASSAGES, "op6_mixing": MIXING, "op7_suffixes": BYTE_PASSAGES, "op9_licenses": LICENSES, "op13_interactions": INTERACTIONS}
