"""DuckDB equivalents of the text queries that SQL can express."""

from threadlake.llm.conversations import BLANK_ENTITIES

KEPT = """kept as (select * from (select *, row_number() over (partition by conv_id, id order by coalesce(version, 0) desc, row_no desc) as rn
  from messages where conv_id is not null) where rn = 1)"""

MRI = r"lower(regexp_replace(sender_mri, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))"

BARE = rf"""regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), '<!--.*?-->|</?[A-Za-z!?][^>]*>', '', 'gs'),
  '&(({BLANK_ENTITIES});|#0*(32|160|173|8194|8195|8201|8203|8204|8205|8206|8207|8288|65279);|#[xX]0*(20|[aA]0|[aA][dD]|200[0-9a-fA-F]|2060|[fF][eE][fF][fF]);)', '', 'g'),
  '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}\x{{034F}}\x{{2800}}\x{{3164}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"""

SPEAKING = f"""speaking as (select *, not coalesce(is_system, false) and {BARE} <> '' as speaks, case when {MRI} like '8:%' then {MRI} end as person from kept)"""

REASONS = """broken as (select distinct k.conv_id from kept k where k.root_id is not null and not exists (select 1 from kept r where r.conv_id = k.conv_id and r.id = k.root_id)),
talk as (select conv_id, bool_or(speaks) as speaks, count(distinct person) filter (speaks) as people from speaking group by conv_id),
reasons as (select conv_id, 'broken' as reason from broken union all select conv_id, 'empty' from talk where not speaks union all select conv_id, 'no_reply' from talk where speaks and people < 2)"""

P3 = f"with {KEPT}, {SPEAKING}, {REASONS} select conv_id, reason from reasons"

P3_CONVERSATIONS = f"""
with recursive {KEPT}, {SPEAKING}, {REASONS},
good as (select *, coalesce(ts, 0) as t, {MRI} as mri from speaking where conv_id not in (select conv_id from reasons)),
frag as (select conv_id, id, coalesce(lag(id) over (partition by conv_id, root_id order by t, id), root_id) as prefix from good where root_id is not null and root_id <> id),
succ as (select conv_id, prefix, count(*) as n from frag group by all),
edge as (select conv_id, id, prefix from frag join succ using (conv_id, prefix) where n = 1),
path as (
  select conv_id, id, id as head, 0 as place from good g where not exists (select 1 from edge e where e.conv_id = g.conv_id and e.id = g.id)
  union all select e.conv_id, e.id, p.head, p.place + 1 from path p join edge e on e.conv_id = p.conv_id and e.prefix = p.id),
placed as (select g.*, h.t as head_ts, p.head, p.place from good g join path p using (conv_id, id) join good h on h.conv_id = p.conv_id and h.id = p.head),
rows as (select * from placed where speaks or coalesce(is_system, false)),
firsts as (select conv_id, person, min((t, id)) as f from rows where speaks and person is not null group by all),
numbered as (select conv_id, person, row_number() over (partition by conv_id order by f) as k from firsts)
select r.conv_id, row_number() over (partition by r.conv_id order by r.head_ts, r.head, r.place) - 1 as position, r.id, r.t as ts, r.content,
  case when coalesce(r.is_system, false) then 'system' when n.k is not null then 'speaker_' || n.k when r.mri like '28:%' then 'bot' else 'unknown' end as role
from rows r left join numbered n on n.conv_id = r.conv_id and n.person = r.person
"""

SQL = {"p3_found": P3, "p3_conversations": P3_CONVERSATIONS}
