"""DuckDB equivalents of the queries in ``core``."""

KEPT = """kept as (select * from (select *, row_number() over (partition by conv_id, id order by coalesce(version, 0) desc, row_no desc) as rn
  from messages where conv_id is not null) where rn = 1)"""

MRI = r"lower(regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'))"

P2 = """
with recursive raw as (select cache_id, file_no, store, rec_key, raw_id, payload::json as payload from raw_records
    where cache_id is not null and file_no is not null and store is not null),
node as (
  select r.cache_id, r.file_no, r.store, r.rec_key, r.raw_id, j.key as path, j.type as kind, j.value as v from raw r, json_each(r.payload) j
  union all
  select n.cache_id, n.file_no, n.store, n.rec_key, n.raw_id, n.path || '.' || j.key, j.type, j.value from node n, json_each(n.v) j where n.kind = 'OBJECT'),
leaf as (select *, case kind when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'number' end as type from node where kind <> 'OBJECT'),
seen as (select cache_id, store, file_no, path, list_sort(list(distinct type) filter (type is not null)) as types from leaf group by all),
files as (select distinct cache_id, store, file_no from raw),
steps as (select *, lag(file_no) over w as prev, lead(file_no) over w as nxt from files window w as (partition by cache_id, store order by file_no)),
neu as (select s.cache_id, s.store, s.file_no, s.path, s.types from seen s join steps t using (cache_id, store, file_no) where t.prev is not null),
alt as (select s.cache_id, s.store, t.nxt as file_no, s.path, s.types from seen s join steps t using (cache_id, store, file_no) where t.nxt is not null),
plain as (select cache_id, store, file_no, path, case when neu.path is null then 'removed' when alt.path is null then 'added'
    when len(alt.types) > 0 and len(neu.types) > 0 and alt.types <> neu.types then 'type_changed' end as change_type
  from (select *, path as p0 from alt) alt full join (select *, path as p0 from neu) neu using (cache_id, store, file_no, path)),
changed as (select cache_id, store, file_no, path, change_type from
  (select coalesce(a.cache_id, n.cache_id) as cache_id, coalesce(a.store, n.store) as store, coalesce(a.file_no, n.file_no) as file_no, coalesce(a.path, n.path) as path,
    case when n.path is null then 'removed' when a.path is null then 'added' when len(a.types) > 0 and len(n.types) > 0 and a.types <> n.types then 'type_changed' end as change_type
   from alt a full join neu n on a.cache_id = n.cache_id and a.store = n.store and a.file_no = n.file_no and a.path = n.path) where change_type is not null),
val as (select cache_id, store, file_no, rec_key, path, arg_max(case when type is not null then v::varchar end, raw_id) as v from leaf where rec_key is not null group by all),
pairs as (select g.cache_id, g.store, g.file_no, t.prev, g.path as field_name, c.path as new_name
  from changed g join changed c on g.cache_id = c.cache_id and g.store = c.store and g.file_no = c.file_no and g.change_type = 'removed' and c.change_type = 'added'
  join steps t on t.cache_id = g.cache_id and t.store = g.store and t.file_no = g.file_no),
recs as (select distinct cache_id, store, file_no, rec_key from raw where rec_key is not null),
same as (select p.cache_id, p.store, p.file_no, p.field_name, p.new_name, count(case when o.v is not null and n.v is not null then 1 end) as n
  from pairs p
  join recs ro on ro.cache_id = p.cache_id and ro.store = p.store and ro.file_no = p.prev
  join recs rn on rn.cache_id = p.cache_id and rn.store = p.store and rn.file_no = p.file_no and rn.rec_key = ro.rec_key
  left join val o on o.cache_id = p.cache_id and o.store = p.store and o.file_no = p.prev and o.rec_key = ro.rec_key and o.path = p.field_name
  left join val n on n.cache_id = p.cache_id and n.store = p.store and n.file_no = p.file_no and n.rec_key = ro.rec_key and n.path = p.new_name
  group by all having bool_and(o.v is not distinct from n.v) and count(case when o.v is not null and n.v is not null then 1 end) >= 2),
r1 as (select * from (select *, row_number() over (partition by cache_id, store, file_no, field_name order by n desc, new_name) as r from same) where r = 1),
ren as (select * from (select * exclude (r), row_number() over (partition by cache_id, store, file_no, new_name order by n desc, field_name) as r from r1) where r = 1)
select cache_id, file_no, store, change_type, path as field_name, '' as new_name from changed c
where not exists (select 1 from ren where ren.cache_id = c.cache_id and ren.store = c.store and ren.file_no = c.file_no
  and ((c.change_type = 'removed' and ren.field_name = c.path) or (c.change_type = 'added' and ren.new_name = c.path)))
union all select cache_id, file_no, store, 'renamed', field_name, new_name from ren
"""



def _promoted(first: float, approved: float, columns: str) -> str:
    """Counts of records, of values replayed and of records with rescued values, under the fields' majority types."""
    head = P2[: P2.index("files as (select distinct")]
    return head + f"""
per_type as (select store, path, type, count(*) as n from (select store, path, unnest(case when len(types) = 0 then [null] else types end) as type from seen) group by all),
best as (select store, path, arg_max(type, (n, type)) filter (type is not null) as kind, sum(n) as held from per_type group by all),
size as (select store, count(*) as files from (select distinct cache_id, store, file_no from raw) group by all),
fields as (select store, path, kind, held / files >= {first} as base from best join size using (store) where kind is not null and held / files >= {approved}),
once as (select * from (select *, row_number() over (partition by cache_id, file_no, store, rec_key order by raw_id desc) as rn from raw) where rn = 1),
cell as (select l.raw_id, f.base, l.type is null as none, f.kind is not null and (l.type is null or l.type = f.kind or (f.kind = 'number' and l.type = 'string' and try_cast(l.v->>'$' as double) is not null)
    or (f.kind = 'boolean' and l.type = 'string' and l.v->>'$' in ('true', 'false'))) as fits
  from leaf l left join fields f on f.store = l.store and f.path = l.path),
per_record as (select raw_id, count(*) filter (fits and not base and not none) as replayed, bool_or(not fits) as rescued from cell group by all),
counts as (select o.store, o.cache_id, o.file_no, count(*)::bigint as records, coalesce(sum(replayed), 0)::bigint as replayed, count(*) filter (p.rescued)::bigint as rescued from once o left join per_record p using (raw_id) group by all)
select {columns} from counts
"""


P4 = f"""
with {KEPT},
said as (select {MRI.format('sender_mri')} as sender_mri, ts, conv_id from kept where not coalesce(is_system, false) and ts > 0),
person as (select *, case when ts - lag(ts) over (partition by sender_mri order by ts) <= 1800000 then 0 else 1 end as new from said where sender_mri like '8:%'),
numbered as (select *, sum(new) over (partition by sender_mri order by ts rows unbounded preceding) as s from person)
select sender_mri, min(ts) as start_ts, max(ts) as end_ts, count(*)::bigint as n_messages, count(distinct conv_id)::bigint as n_convs from numbered group by sender_mri, s
"""

P5 = f"""
with rows as (
  select {MRI.format('owner_mri')} as owner_mri, start_ts, end_ts from calendar_events where not coalesce(is_cancelled, false)
  union all
  select {MRI.format('owner_mri')}, start_ts, start_ts + duration_ms from calls where not coalesce(is_deleted, false)),
ok as (select * from rows where owner_mri <> '' and start_ts > 0 and end_ts > start_ts),
reach as (select *, max(end_ts) over (partition by owner_mri order by start_ts, end_ts rows between unbounded preceding and 1 preceding) as reached from ok),
island as (select *, sum(case when reached is null or start_ts > reached then 1 else 0 end) over (partition by owner_mri order by start_ts, end_ts rows unbounded preceding) as g from reach),
period as (select owner_mri, g, min(start_ts) as start_ts, max(end_ts) as end_ts from island group by owner_mri, g),
nxt as (select *, lead(start_ts) over (partition by owner_mri order by start_ts) as next_start from period)
select owner_mri, 'period' as what, start_ts, end_ts from nxt
union all select owner_mri, 'gap', end_ts, next_start from nxt where next_start is not null
"""

LAST_RUN = """last_run as (select * from (select *, row_number() over (partition by cache_id order by finished_at desc, run_id desc) as rn
  from refresh_states where outcome in ('inplace', 'swapped') and finished_at is not null and cache_id is not null) where rn = 1)"""

P6 = f"""
with {LAST_RUN},
sig as (select cache_id, e.key as entity, unnest(string_split(e.value, ',')) as part from (select cache_id, unnest(map_entries(store_sigs)) as e from last_run)),
taken as (select cache_id, entity, trim(split_part(part, ':', 1)) || ':' || trim(split_part(part, ':', 2)) as target, max(try_cast(split_part(part, ':', 3) as bigint)) as hi from sig group by 1, 2, 3)
select distinct e.cache_id, e.seq from store_entries e
left join last_run r on r.cache_id = e.cache_id
left join taken t on t.cache_id = e.cache_id and t.entity = e.entity and t.target = e.db_id || ':' || e.os_id
where e.cache_id is not null and e.seq is not null
  and not coalesce(case when e.entity in ('profile', 'event', 'call') then e.seq <= t.hi else e.seq <= r.max_seq end, false)
"""

P7 = """
with once as (select distinct cache_id, entry_key, seq, op_type, coalesce(try_cast(version as hugeint), 0) as v from store_entries
  where cache_id is not null and entry_key is not null and seq is not null),
gone as (select cache_id, entry_key, max(seq) as last from once where op_type = 0 group by all),
alive as (select o.* from once o left join gone g using (cache_id, entry_key) where o.op_type = 1 and (g.last is null or o.seq > g.last))
select cache_id, entry_key, seq from (select *, row_number() over (partition by cache_id, entry_key order by v desc, seq desc) as rn from alive) where rn = 1
"""

DESCRIBE = P2[: P2.index("files as (select distinct")].rstrip(", \n") + " select store, path, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') as types, count(*) as files from seen group by store, path"

P6_LEDGER = """
with e as (select cache_id, seq, coalesce(epoch_us(landed_at), (select min(epoch_us(landed_at)) from store_entries where cache_id is not null and seq is not null)) as tm from store_entries where cache_id is not null and seq is not null),
s as (select min(tm) as a, max(tm) as b from e), f as (select cache_id, seq, min(tm) as tm from e group by all),
r as (select cache_id, case when tm <= a + (b - a) * 1 // 3 then 1 when tm <= a + (b - a) * 2 // 3 then 2 else 3 end::int as run from f, s)
select run, cache_id, count(*) as n from r group by all
"""

SQL = {"p6_ledger": P6_LEDGER, "p2_found": P2, "describe_schema": DESCRIBE, "p2_promoted": _promoted(0.9, 0.5, "*"), "p2_rescued": _promoted(0.5, 0.5, "store, cache_id, file_no, records, rescued"), "p4_found": P4, "p5_found": P5, "p6_found": P6, "p7_found": P7}
