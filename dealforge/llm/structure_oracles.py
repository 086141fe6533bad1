"""SQL twins of conversation repair, the Merkle manifest and sharding."""

#: Tables for CRC-32: ``crc_t`` a list over bytes, ``crc_far`` what byte b adds when d bytes follow, ``crc_4`` its last four rows as lists.
CRC = """
crc_t as (select list(c order by i) as t from (select i, list_reduce([i::bigint] || [0::bigint for x in range(8)], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c from range(256) r(i))),
crc_far as (select 0::bigint as d, i as b, t[i + 1] as c from range(256) r(i), crc_t union all select d + 1, b, xor(t[(c & 255) + 1], c >> 8) from crc_far, crc_t where d < 255),
crc_4 as (select max(l) filter (d = 255) as l1, max(l) filter (d = 254) as l2, max(l) filter (d = 253) as l3, max(l) filter (d = 252) as l4 from (select d, list(c order by b) as l from crc_far where d >= 252 group by d))
"""


def crc_of(name: str, source: str) -> str:
    """CTEs that end in ``name`` (id, crc): CRC-32 of ``h``, hex bytes, of each row (id, h) of ``source``.

    Four bytes before the text stand for the initial register. Bytes are added up in blocks of 256, blocks from first to last.
    """
    return f"""
{name}_x as (select id, regexp_extract_all('62F52692' || h, '..') as x from ({source})),
{name}_b as (select id, len(x) - 1 - unnest(range(len(x))) as d, ('0x' || unnest(x))::bigint as b from {name}_x),
{name}_v as (select id, {name}_b.d // 256 as k, bit_xor(c) as v from {name}_b join crc_far f on f.d = {name}_b.d % 256 and f.b = {name}_b.b group by all),
{name}_h as (select id, k, v from {name}_v where (id, k) in (select id, max(k) from {name}_v group by id) union all
  select p.id, p.k - 1, xor(xor(xor(xor(l1[(p.v & 255) + 1], l2[((p.v >> 8) & 255) + 1]), l3[((p.v >> 16) & 255) + 1]), l4[(p.v >> 24) + 1]), q.v) from {name}_h p, crc_4, {name}_v q where q.id = p.id and q.k = p.k - 1),
{name} as (select id, xor(v, 4294967295::bigint) as crc from {name}_h where k = 0)"""


SHARDS = f"""
with recursive {CRC}, {crc_of("crcs", "select doc_id as id, hex(encode(coalesce(text, ''))) as h from documents")},
d as (select doc_id, strlen(coalesce(text, '')) + 16 as size, crc from documents join crcs on id = doc_id),
p as (select *, sum(size) over (order by doc_id, crc rows unbounded preceding) - size as before, sum(size) over () as whole from d),
s as (select *, cast((2 * before + size) * 40 // (2 * whole) as int) as shard from p)
select doc_id, size::bigint as size, crc as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, crc) - 1 as slot, null::int as grown_shard from s
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: One digest of a run, its place's own replaced by x.
_WITH = "sha256(array_to_string([case when i = r % 3 then {x} else run[i + 1] end for i in range(len(run))], ''))"
_OTHERS = "array_to_string([run[i + 1] for i in range(len(run)) if i <> r % 3], '')"

MERKLE = f"""
with recursive {CRC}, {crc_of("crcs", "select doc_id as id, hex(encode(doc_id::varchar)) as h from documents")},
d as (select doc_id, source, {_leaf("text")} as leaf, case when crc % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as claim from documents join crcs on id = doc_id),
l as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as r, count(*) over (partition by source) as n from d),
t as (select source, 0 as lv, r, n, leaf as x from l union all select source, lv + 1, r // 3, (n + 2) // 3, sha256(string_agg(x, '' order by r)) from t where n > 1 group by source, lv, n, r // 3),
runs as (select source, lv, r // 3 as p, list(x order by r) as run from t where n > 1 group by all),
s as (select source, x, row_number() over (order by source nulls first) - 1 as r, count(*) over () as n from t where n = 1),
u as (select 0 as lv, r, n, x from s union all select lv + 1, r // 3, (n + 2) // 3, sha256(string_agg(x, '' order by r)) from u where n > 1 group by lv, n, r // 3),
tops as (select lv, r // 3 as p, list(x order by r) as run from u where n > 1 group by all),
a as (select doc_id, source, leaf, 0 as lv, r, n, claim as f, '' as proof from l union all
  select doc_id, a.source, leaf, a.lv + 1, r // 3, (n + 2) // 3, {_WITH.format(x="f")}, proof || {_OTHERS} from a join runs on runs.source is not distinct from a.source and runs.lv = a.lv and runs.p = r // 3 where n > 1),
b as (select a.doc_id, a.leaf, s.x as subroot, 0 as lv, s.r, s.n, a.f, a.proof from a join s on s.source is not distinct from a.source where a.n = 1 union all
  select doc_id, leaf, subroot, b.lv + 1, r // 3, (n + 2) // 3, {_WITH.format(x="f")}, proof || {_OTHERS} from b join tops on tops.lv = b.lv and tops.p = r // 3 where n > 1)
select doc_id, leaf, subroot, u.x as root, sha256(proof) as proof_sha256, f as folded_root, f = u.x as verified from b, u where b.n = 1 and u.n = 1
"""

REPAIR = rf"""
with recursive {CRC}, {crc_of("crcs", "select distinct coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as id, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations")},
f as (select conv_id, turn, crc % 20 as k, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations join crcs on id = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')),
g as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) from f where k <> 0),
h as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as tt from g),
o as (select *, tt = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, right(tt, 1) not in ('.', '!', '?') as cut, left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by i) as before from h),
m as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (cut and not again and not blank) as truncated,
  count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal, count(*) as n from o group by conv_id),
ins(s, a, t, w, x) as (values (0, '', 0, 0, ''), (0, 'I', 2, 2, chr(10) || 'user:'), (0, 'II', 3, 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, '', 1, 0, ''), (1, 'I', 2, 2, chr(10) || 'user:'), (1, 'II', 3, 4, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, '', 2, 0, ''), (2, 'I', 3, 2, chr(10) || 'assistant:'), (2, 'II', 2, 4, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, '', 3, 0, ''), (3, 'I', 2, 2, chr(10) || 'user:'), (3, 'II', 3, 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
act(a, s, t, w) as (values ('K', 0, 1, 0), ('K', 0, 2, 0), ('K', 1, 2, 0), ('K', 3, 2, 0), ('K', 2, 3, 0), ('R', 0, 2, 2), ('R', 1, 2, 2), ('R', 3, 2, 2), ('R', 2, 3, 2), ('D', 0, 0, 3), ('D', 1, 1, 3), ('D', 2, 2, 3), ('D', 3, 3, 3)),
dp as (select conv_id, 0::bigint as i, 0 as s, {{'w': 0::bigint, 'a': '', 'x': ''}} as b from m union all
  select dp.conv_id, o.i, act.t, min({{'w': b.w + ins.w + act.w + case when act.a <> 'D' and o.cut then 1 else 0 end, 'a': b.a || ins.a || act.a,
    'x': b.x || ins.x || case act.a when 'D' then '' when 'K' then chr(10) || o.role || ':' || o.text else chr(10) || (case act.t when 2 then 'user:' else 'assistant:' end) || o.text end}})
  from dp join o on o.conv_id is not distinct from dp.conv_id and o.i = dp.i + 1 join ins on ins.s = dp.s join act on act.s = ins.t
  where case when o.blank or o.again then act.a = 'D' when act.a = 'K' then (o.c = 's' and act.t = 1) or (o.c = 'u' and act.t = 2) or (o.c = 'a' and act.t = 3) else true end
  group by dp.conv_id, o.i, act.t),
e as (select dp.conv_id, min({{'w': b.w + ins.w, 'a': b.a || ins.a, 'x': b.x || ins.x}}) as b from dp join m on m.conv_id is not distinct from dp.conv_id and m.n = dp.i join ins on ins.s = dp.s where ins.t in (0, 3) group by dp.conv_id),
c as (select distinct conv_id from conversations)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.w, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(substr(coalesce(b.x, ''), 2)) as repaired_sha256
from c left join m on m.conv_id is not distinct from c.conv_id left join e on e.conv_id is not distinct from c.conv_id
"""

ORACLES = {"op11_conversation_repair": REPAIR, "op12_merkle_manifest": MERKLE, "op13_byte_shards": SHARDS}
