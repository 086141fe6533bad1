"""SQL twins of those corpus queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Components: every node reaches itself and what its links reach.
REACH = "reach as (select id, id as c from nodes union select e.b, r.c from reach r join edges e on e.a = r.id), comp as (select id, min(c) as component_id from reach group by id)"

REPEATS = """
with d as (select doc_id, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, unnest(range(0, len(h) // 2 - 399)) as p, h from d where len(h) >= 800),
w as (select doc_id, p, md5(substr(h, 2 * p + 1, 800)) as m from p),
r as (select doc_id, p from w where m in (select m from w group by m having count(*) > 1)),
g as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 400 then 0 else 1 end as new from r),
i as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from g),
s as (select doc_id, k, min(p) as s, max(p) + 400 as e from i group by doc_id, k),
q as (select doc_id, k, s, e, coalesce(lag(e) over (partition by doc_id order by k), 0) as before from s),
x as (select q.doc_id, count(*) as n_spans, sum(e - s) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by k) || substr(any_value(h), 2 * max(e) + 1) as kept from q join d using (doc_id) group by q.doc_id)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(unhex(kept), encode(t))) as kept_sha256 from d left join x using (doc_id)
"""


def _kind(kind: str, pattern: str, ok: str) -> str:
    m, p = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')"
    return f"""{kind}_m as (select doc_id, t, {m} as m, {p} as p from d),
{kind}_x as (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'm': m[i]}})) as x from {kind}_m where len(m) > 0),
{kind}_s as (select doc_id, cast(x.s as bigint) as s, cast(x.s + length(x.m) as bigint) as e from {kind}_x where {ok}),
{kind} as (select doc_id, count(*) as n, string_agg('{kind}:' || s || ':' || e, ',' order by s) as l from {kind}_s group by doc_id)"""


DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: case when i % 2 = 0 then (cast(substr({DIGITS}, -i, 1) as int) * 2) // 10 + (cast(substr({DIGITS}, -i, 1) as int) * 2) % 10 else cast(substr({DIGITS}, -i, 1) as int) end)) % 10 = 0"
KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(x.m, '.'), lambda y: cast(y as hugeint))) <= 255"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) between 16 and 19 and {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) between 8 and 15"),
}
#: Base kinds only: the tables hold no account number, whose pattern needs look-around.
PERSONAL = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), " + ", ".join(_kind(k, p, ok) for k, (p, ok) in KINDS.items())
    + ", a as (select d.doc_id, " + ", ".join(f"coalesce({k}.n, 0) as n_{k}" for k in KINDS) + ", concat_ws(',', " + ", ".join(f"{k}.l" for k in KINDS) + ") as spans from d "
    + " ".join(f"left join {k} on {k}.doc_id = d.doc_id" for k in KINDS) + ") select *, sha256(spans) as base_sha256 from a"
)

VECTORS = f"""
with recursive v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings),
good as (select id, x from v where x is not null and not list_contains(list_transform(x, lambda y: y is null or not isfinite(y)), true) and list_contains(list_transform(x, lambda y: y <> 0), true)),
nodes as (select id from v), edges as (select p.id as a, q.id as b from good p join good q on p.id <> q.id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.95), {REACH},
n as (select a as id, count(*) as k from edges group by a)
select comp.id as vec_id, coalesce(k, 0) as n_links, component_id, comp.id = component_id as kept from comp left join n using (id)
"""

MIX = f"""
with s as (select doc_id, source, len({WORDS.format("coalesce(text, '')")})::bigint as size, (cast('0x' || substr(md5('mix:' || doc_id), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double as u from documents),
t as (select source, sum(size)::bigint as ss from s group by source),
o as (select *, list_extract([5.0::double, 2.0::double, 1.0::double], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)) as w, ss * 2.0::double as cap from t),
f as (select *, coalesce(sum(cap) over b, 0) as cb, coalesce(sum(w) over b, 0) as wb, sum(ss) over () * 1.5::double as total, sum(w) over () as wall, row_number() over (order by cap / w, source nulls last) as place from o
      window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (total - cb) / (wall - wb) as level from f),
p as (select source, ss, least(cap, coalesce((select arg_min(level, place) from l where level * w <= cap) * w, cap)) as target from l),
k as (select *, case when ss > 0 then cast(floor(target / ss) as bigint) else 0 end as whole from p),
r as (select *, target - whole * ss as rest, case when target - whole * ss > 0 then (target - whole * ss) / (ss - (target - whole * ss)) end as odds from k),
q as (select s.doc_id, s.source, s.size, r.ss, r.target, r.whole, r.rest, r.odds, (s.u / (1 - s.u)) / r.odds as q from s join r on s.source is not distinct from r.source),
c as (select *, sum(size) over (partition by source order by q, doc_id rows unbounded preceding) as upto from q),
g as (select *, coalesce(upto <= rest, false) and odds is not null as fits, rest - coalesce(max(case when upto <= rest then upto end) over (partition by source), 0) as gap from c),
m as (select source, arg_min(doc_id, {{'o': abs(gap - size), 'q': q, 'd': doc_id}}) as fill from g where odds is not null and not fits and abs(gap - size) < gap group by source)
select g.doc_id, g.size, g.ss as source_size, g.target, cast((whole + case when fits or coalesce(g.doc_id = m.fill, false) then 1 else 0 end) * g.size as bigint) as taken from g left join m on g.source is not distinct from m.source
"""

CHAT = """
with t as (select conv_id as conv, turn, min({'r': coalesce(role, ''), 't': coalesce(text, '')}) as said from conversations where conv_id is not null and turn is not null group by all),
m as (select a.conv >> 1 as k, min(turn) as lo, max(turn) as hi from t a join t b using (turn) where a.conv & 1 = 0 and b.conv = a.conv + 1 and a.said.r = 'assistant' and b.said.r = 'assistant' group by all),
p as (select k * 2 + i as conv, k * 2 + 1 - i as other, case when k % 2 = 0 then lo else hi end as cut_ from m, (values (0), (1)) v(i)),
c as (select t.conv, turn, said from t join p using (conv)),
r as (select t.conv, turn, said from t join p using (conv) where turn < cut_ union all select p.conv, turn, said from p join t on t.conv = other where turn >= cut_),
f as (select coalesce(c.conv, r.conv) as conv, coalesce(c.turn, r.turn) as turn, c.said as a, r.said as b from c full join r on c.conv = r.conv and c.turn = r.turn),
s as (select conv, min(turn) as cut_ from f where a is distinct from b group by conv),
x as (select f.conv, turn, 'prompt' as part, a as said from f join s using (conv) where turn < cut_ union all select f.conv, turn, 'chosen', a from f join s using (conv) where turn >= cut_ and a is not null union all select f.conv, turn, 'rejected', b from f join s using (conv) where turn >= cut_ and b is not null)
select conv as pair_id, part, turn, said.r as role, '<|' || said.r || '|>' || chr(10) || said.t || '<|end|>' || chr(10) as text, part <> 'prompt' and said.r = 'assistant' as train from x
"""

JACCARD = f"""
with recursive w as (select doc_id as id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sh as (select distinct id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from w where len(w) > 0),
n as (select id, count(*) as n from sh group by id), pairs as (select a.id as a, b.id as b, count(*) as k from sh a join sh b on a.s = b.s and a.id <> b.id group by all),
edges as (select a, b from pairs join n x on x.id = a join n y on y.id = b where 100 * k >= 80 * (x.n + y.n - k)), nodes as (select id from w), {REACH}
select w.id as doc_id, coalesce(n, 0) as n_shingles, component_id from w left join n using (id) join comp using (id)
"""

ORACLES = {"op1_suffix_repeats": REPEATS, "op3_pii": PERSONAL, "op4_embedding_dedup": VECTORS, "op6_source_mix": MIX, "op8_chat_preferences": CHAT, "op9_ngram_jaccard": JACCARD}
