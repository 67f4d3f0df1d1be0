"""SQL of resampling, conversation repair and sharding, for DuckDB."""

from __future__ import annotations

#: The table of CRC-32 by byte, from its polynomial.
_TABLE = """tab as (select list_transform(range(256), lambda n: list_reduce(range(8),
  lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, n)) as crc_table)"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text; needs ``tab``."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    return f"xor(4294967295, list_reduce({digits}, lambda x, b: xor(x // 256, crc_table[xor(x, b) % 256 + 1]), 4294967295))"


def resampling() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with {_TABLE},
texts as (select 0 as side, doc_id, row_number() over () as r, text from documents union all select 1, null, row_number() over (), text from benchmark),
cut as (select side, doc_id, r, coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from texts),
words as (select side, r, unnest(w) as w, unnest(range(len(w))) as i from cut),
ahead as (select side, r, w, lead(w) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by side, r order by i)),
runs as (select side, r, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) as f from ahead),
counted as (select side, r, f, count(*) as n from runs where f is not null group by all),
names as (select f, {_crc("f")} % 10000 as bucket from (select distinct f from counted), tab),
features as (select side, r, bucket, sum(n) as n from counted join names using (f) group by all),
sums as (select bucket, coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from features group by 1),
totals as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from sums),
gains as (select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::bigint as gain from sums, totals),
weighed as (select r, sum(n) as n, sum(n * gain) as weight from features join gains using (bucket) where side = 0 group by 1),
scored as (select doc_id, len(w) as words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from (select * from cut where side = 0) left join weighed using (r)),
ranked as (select *, case when words >= 20 then row_number() over (partition by words >= 20 order by score desc, doc_id nulls first, n_features) end as rank from scored)
select doc_id, n_features, weight, score, case when rank <= (select count(*) * 5 // 100 from scored where words >= 20) then rank end as rank from ranked
"""


def repair() -> str:
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    return rf"""
with recursive {_TABLE},
source as (select conv_id, turn::bigint as turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc(key)} % 20 as f from conversations, tab),
damaged as (select conv_id, turn, case when f = 4 then 'user' else role end as role,
  case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from source, (select unnest([0, 1]) as copy) where f <> 0 and (copy = 0 or f = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) as nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from placed),
turns as (select conv_id, i, turn, role, text, left(role, 1) as ini, case when last = '' then 1 when nth > 1 then 2 when last not in ('.', '!', '?') then 3 else 0 end as fault from seen),
follows(st, nxt, name, role) as (values (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
runs(st, mid, ins, added) as (select st, st, '', '' from follows union all select st, nxt, 'I', chr(10) || role || ':' from follows
  union all select a.st, b.nxt, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' from follows a join follows b on b.st = a.nxt),
ways as (select conv_id, i, r.st, r.mid as nxt, 3 * len(ins) + 4 as cost, ins || 'D' as edit, added as lines from turns, runs r
  union all select conv_id, i, r.st, n.nxt, 3 * len(ins) + (case when ini = n.name then 0 else 3 end) + (case when fault = 3 then 3 else 0 end),
    ins || (case when ini = n.name then 'K' else 'R' end), added || chr(10) || (case when ini = n.name then t.role else n.role end) || ':' || text
  from turns t, runs r join follows n on n.st = r.mid where fault not in (1, 2)
  union all select conv_id, i, r.st, 1, 3 * len(ins) + (case when fault = 3 then 3 else 0 end), ins || 'K', added || chr(10) || t.role || ':' || text
  from turns t, runs r where r.mid = 0 and ini = 's' and fault not in (1, 2)),
paths as (select conv_id, 0::bigint as i, 0 as st, {{'cost': 0::bigint, 'audit': '', 'lines': ''}} as best from (select distinct conv_id from conversations)
  union all select p.conv_id, w.i, w.nxt, min({{'cost': p.best.cost + w.cost, 'audit': p.best.audit || w.edit, 'lines': p.best.lines || w.lines}})
  from paths p join ways w on w.conv_id is not distinct from p.conv_id and w.i = p.i + 1 and w.st = p.st group by 1, 2, 3),
ends as (select p.conv_id, min({{'cost': best.cost + 3 * len(r.ins), 'audit': best.audit || r.ins, 'lines': best.lines || r.added}}) as best
  from paths p join runs r on r.st = p.st and r.mid in (0, 3)
  where p.i = (select count(*) from turns t where t.conv_id is not distinct from p.conv_id) group by 1),
figures as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
  count(*) filter (fault = 3) as truncated, count(*) filter (before || ini not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(ini) over (partition by conv_id order by i) as before from turns) group by 1)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, best.cost as cost, best.audit as audit, sha256(substr(best.lines, 2)) as repaired_sha256
from ends e left join figures f on f.conv_id is not distinct from e.conv_id
"""


def sharding(shards: int = 16, vnodes: int = 256) -> str:
    rounds = "".join(
        f"""asked{r} as (select p.* exclude (shard), shard is not null as had, coalesce(shard, own) as goal from placed{r} p join walk using (point) where turn = {r}),
placed{r + 1} as (select point, sub, bytes, rows, case when had or before < full_at then goal end as shard from (select *, coalesce(sum(bytes) over (partition by goal
  order by had desc, bytes desc, point, sub rows between unbounded preceding and 1 preceding), 0) as before from asked{r}), whole),
"""
        for r in range(shards)
    )
    return f"""
with {_TABLE},
sized as (select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size, {_crc("coalesce(text, '')")}::bigint as text_crc32,
  ('0x' || md5(coalesce(doc_id::varchar, ''))[1:4])::bigint as point from documents, tab),
whole as (select sum(size) as total, -((-sum(size)::bigint * 1001 - {1000 * shards - 1}) // {1000 * shards}) as full_at from sized),
heavy as (select point, least(count(*), ceil(sum(size) * 65536 / any_value(total)::double))::bigint as parts from sized, whole group by 1 having sum(size) * 4096 > any_value(total)),
docs as (select s.*, case when parts > 1 then ('0x' || md5(coalesce(doc_id::varchar, '') || ':' || text_crc32)[1:8])::bigint % parts else 0 end as sub from sized s left join heavy using (point)),
nodes as (select *, row_number() over (order by spot, tie, own) - 1 as i from (select id % {shards} as own, ('0x' || md5(name)[1:4])::bigint as spot, md5(name) as tie
  from (select id, 'shard ' || (id % {shards}) || ' ' || (id // {shards}) as name from range({shards * vnodes}) t(id)))),
walk as (select point, own, row_number() over (partition by point order by met) - 1 as turn from (select point, own, coalesce(min(i) filter (spot >= point), min(i) + {shards * vnodes}) as met
  from (select distinct point from docs), nodes group by 1, 2)),
placed0 as (select point, sub, sum(size) as bytes, count(*) as rows, null::int as shard from docs group by 1, 2),
{rounds}based as (select point, sub, shard, coalesce(sum(rows) over (partition by shard order by point, sub rows between unbounded preceding and 1 preceding), 0) as base from placed{shards})
select doc_id, size, text_crc32, 'bytes' as law, shard::int as shard, (base + row_number() over (partition by point, sub order by doc_id nulls first, text_crc32, size) - 1)::bigint as slot, null::int as grown_shard
from docs join based using (point, sub)
"""
