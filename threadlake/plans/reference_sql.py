"""DuckDB equivalents of the queries in ``reference``."""

from threadlake.plans.core_sql import MRI, P6
from threadlake.plans.search import STOPWORDS

KIND = "case when {0} like '%@unq.gbl.spaces%' then '1:1' when {0} like '%meeting\\_%' escape '\\' then 'meeting' when {0} like '%@thread.v2%' then 'group' when {0} like '%@thread.skype%' or {0} like '%@thread.tacv2%' then 'channel' else 'other' end"

M = f"""m as (select conv_id, id, row_no, coalesce(version, 0) as version, coalesce(ts, 0) as ts, coalesce({MRI.format('sender_mri')}, '?') as sender, coalesce(sender_name, '') as sender_name,
  {KIND.format('conv_id')} as kind, coalesce(is_mine, false) as is_mine, coalesce(is_system, false) as is_system, coalesce(mentions_me, false) as mentions_me, coalesce(content, '') as content, reactions, coalesce(root_id, id) as root_id
  from (select *, row_number() over (partition by conv_id, id order by coalesce(version, 0) desc, row_no desc) as rn from messages where conv_id is not null) where rn = 1)"""
T = "t as (select *, make_timestamp(ts * 1000) as tm, cast(make_timestamp(ts * 1000) as date) as day from m where not is_system and ts > 0)"
PROF = f"""prof as (select * exclude (mri, rn, cm), cm as mri from (select *, row_number() over (partition by cm order by row_no desc) as rn from
  (select *, {MRI.format('mri')} as cm from profiles) where cm is not null and coalesce(name, '') <> '') where rn = 1)"""
EV = "ev as (select * exclude (rn) from (select *, row_number() over (partition by id order by row_no desc) as rn from calendar_events where id is not null) where rn = 1)"
CALLS = "ca as (select * exclude (rn) from (select *, row_number() over (partition by id order by row_no desc) as rn from calls where id is not null) where rn = 1)"
PEOPLE = "people as (select sender as mri, 'p:' || substr(sha1(sender), 1, 6) as handle, arg_max(sender_name, (ts, id, conv_id)) as name, count(*) as msg_count, max(ts) as last_ts from m where not is_system group by sender)"
CONV = f"""conv as (select conv_id as id, 'c:' || substr(sha1(conv_id), 1, 6) as handle, {KIND.format('conv_id')} as kind, count(*) filter (not is_system) as msg_count,
  count(distinct sender) filter (not is_system) as participant_count, coalesce(max(ts) filter (not is_system), 0) as last_ts from m group by conv_id)"""
ME = "me as (select sender from m where is_mine and sender <> '?' group by sender order by count(*) desc, sender limit 1)"
NAMES = f"""names as (select conv_id, string_agg(name, ', ' order by rn) as participant_names from (
  select conv_id, name, row_number() over (partition by conv_id order by s.last_ts desc, sender) as rn from
    (select conv_id, sender, max(ts) as last_ts from m where not is_system and sender not in (select sender from me) group by all) s join people p on p.mri = s.sender where name <> '')
  where rn <= 5 group by conv_id)"""
LIST = f"with {M}, {PEOPLE}, {CONV}, {ME}, {NAMES}, list as (select c.*, coalesce(participant_names, '') as participant_names from conv c left join names n on n.conv_id = c.id)"
BIG = "big as (select conv_id from m group by conv_id order by count(*) desc, conv_id limit 1)"
CLIP = "case when length({0}) > {1} then substr({0}, 1, {1}) || '…' else {0} end"
STRIP = r"trim(regexp_replace(regexp_replace({0}, '<div\b[^>]*>|</p\s*>|<br\s*/?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), ' ')"
FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
SNIP = CLIP.format(FLAT.format(STRIP.format("content")), 120)
SEARCH = f"with {M} select conv_id, id, ts, sender, {SNIP} as snippet from m where not is_system and "
IX = f"ix as (select conv_id, id, ts, sender, kind, {STRIP.format('content')} as text from m where not is_system and content <> '')"
SLOT = "case when hour(tm) < 6 then 0 when hour(tm) >= 23 then 69 else (hour(tm) - 6) * 4 + minute(tm) // 15 + 1 end::bigint"
PER_DAY = "per_day as (select day, count(*) as n from t group by day)"
RHYTHM = f"rhythm as (select day - dayofweek(day)::int as week, dayofweek(day) as weekday, {SLOT} as slot, count(*) as n from t where sender not like '28:%' group by all)"
WEEKS = "weeks as (select day - dayofweek(day)::int as week, sum(n)::bigint as n from per_day group by all), week_axis as (select a.week, coalesce(w.n, 0) as n from (select unnest(generate_series(min(week)::timestamp, max(week)::timestamp, interval 7 days))::date as week from weeks) a left join weeks w on w.week = a.week)"
AXIS = """top as (select sender from t group by sender order by count(*) desc, sender limit 100),
axis as (select sender, d::date as day from top, (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day)) as d from t)),
filled as (select a.sender, a.day, coalesce(c.n, 0) as n from axis a left join (select sender, day, count(*) as n from t group by all) c on c.sender = a.sender and c.day = a.day),
rolling as (select sender, day, (sum(n) over (partition by sender order by day rows between 34 preceding and current row))::bigint as sum_35d, round(avg(n) over (partition by sender order by day rows between 6 preceding and current row), 6) as mean_7d from filled)"""
ROOTS = "select conv_id, root_id, count(*) as n, max(ts) as last_ts from m where not is_system group by all"
TO_ME = """to_me as (select r.* from t r left join (select conv_id as mc, id as mi, ts as my_ts from t where is_mine) o on o.mc = r.conv_id and o.mi = r.root_id
  where not r.is_mine and r.content <> '' and (r.kind = '1:1' or r.mentions_me or (my_ts is not null and my_ts < r.ts)))"""
TOKENS = r"list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}][\p{{L}}\p{{M}}''’-]{{2,}}'), lambda x: regexp_replace(x, '[''’]s$', ''))"
GRAMS = "select list_aggregate(list_slice(tokens, i, i + g - 1), 'string_agg', ' ') as phrase {0} from {1}, (values (1), (2), (3)) n(g), unnest(generate_series(1, len(tokens) - g + 1)) u(i)"
STOP = "[" + ", ".join("'" + w + "'" for w in STOPWORDS) + "]"
PEOPLE_FIND = f"with {M}, {PEOPLE}, {PROF}, found as (select p.mri, p.handle, coalesce(nullif(p.name, ''), nullif(f.name, '')) as display, f.org, p.msg_count, p.last_ts from people p left join prof f on f.mri = p.mri)"
CALL_LIST = f"""with {M}, {PEOPLE}, {PROF}, {CALLS}, rows as (select id, start_ts, duration_ms, call_type, group_thread_id, {MRI.format('counterpart_mri')} as mri from ca where not coalesce(is_deleted, false)),
found as (select r.id, r.start_ts, r.duration_ms, case when call_type = 'MultiParty' and group_thread_id is not null then 'c:' || substr(sha1(group_thread_id), 1, 6)
  else coalesce(nullif(p.name, ''), nullif(f.name, ''), '(unknown)') end as label from rows r left join people p on p.mri = r.mri left join prof f on f.mri = r.mri)"""
EVENT_LIST = f"""with {EV} select id, coalesce(subject, '') as subject, start_ts, end_ts, coalesce(len(attendees), 0)::int as n_attendees,
  coalesce(len(list_filter(attendees, lambda a: coalesce(lower(a.r) = 'accepted', false))), 0)::int as n_accepted from ev where not coalesce(is_cancelled, false)"""
WIN = "select *, row_number() over (partition by cache_id, entry_key order by seq desc, case when coalesce(file, '') like '%.log' then 1 else 0 end, file, entry_ord, entry_id) as rn from store_entries where cache_id is not null and entry_key is not null and seq is not null"
DB = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(s.db, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<guid>', 'g'), ':[a-z]{2}-[a-zA-Z]{2,4}$', ':<locale>', 'g'), ':\d+(:|$)', ':<n>\1', 'g'), '_\d+_', '_<n>_', 'g')"""
FILES = rf"""files as (select * from (select *, row_number() over (partition by cache_id, file_no order by row_no desc) as rn, regexp_extract(trim(lower(mapping_version)), '^v?(\d+(?:\.\d+)*)$', 1) as v from schema_files where cache_id is not null and file_no is not null) where rn = 1),
fp as (select cache_id, file_no, case when v <> '' then array_to_string(list_slice(list_concat(list_transform(string_split(v, '.'), lambda p: case when ltrim(p, '0') = '' then '0' else ltrim(p, '0') end), ['0', '0']), 1, 3), '.') end as version,
  substr(sha256(array_to_string(list_sort(list_transform(coalesce(stores, []), lambda s: {DB} || '|' || s.store || '|' || array_to_string(list_sort(list_distinct(s.fields)), ','))), ';')), 1, 16) as hash from files)"""



def _topics(scope: str, since: str, kept: str) -> str:
    return f"""with {M}, {PEOPLE}, {PROF}, {IX}, nm as (select distinct unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{M}}]{{3,}}')) as w from (select name from people union all select name from prof)),
r as (select *, row_number() over () as doc from ix where sender not like '28:%' and ts > 0 and {scope}), b as (select {since} as since), z as (select count(*) filter (ts >= since) as win, count(*) filter (ts < since) as base from r, b),
d as (select doc, conv_id, id, ts, sender, ts >= since as new, {TOKENS.format('text')} as tokens from r, b), br as (select *, list_transform(tokens, lambda x: list_contains({STOP}, x) or length(x) < 3 or regexp_full_match(x, '[0-9a-f]{{5,}}')) as bad from d),
g as (select doc, conv_id, id, ts, sender, new, list_aggregate(list_slice(tokens, i, i + g - 1), 'string_agg', ' ') as phrase from br, (values (1), (2), (3)) n(g), unnest(generate_series(1, len(tokens) - g + 1)) u(i) where not list_contains(list_slice(bad, i, i + g - 1), true)),
s as (select phrase, count(*) filter (new) as count, count(distinct doc) filter (new) as df, count(distinct doc) filter (not new) as base_df, count(distinct sender) filter (new) as senders, min((ts, conv_id, id)) filter (new) as f from g group by phrase)
select phrase, count, senders, round((df / greatest(1, win)) / ((base_df + 0.5) / (base + 1)) * log2(1 + count), 6) as score, f[2] as first_conv_id, f[3] as first_id from s, z where count >= 3 and senders >= 2 and {kept}
  and not exists (select 1 from nm where list_contains(string_split(s.phrase, ' '), nm.w))"""


SQL = {
    "conv_list": f"{LIST} select * from list where msg_count > 0",
    "conv_list_kind": f"{LIST} select * from list where msg_count > 0 and kind = 'channel'",
    "conv_list_query": f"{LIST} select * from list where msg_count > 0 and contains(lower(participant_names), 'an')",
    "conv_resolve": f"{LIST} select * from list where handle = (select handle from conv order by msg_count desc, id limit 1)",
    "msg_point_lookup": f"with {M} select conv_id, id, ts, sender from m where (conv_id, id) = (select min((conv_id, id)) from m)",
    "msg_page": f"with {M}, {BIG} select conv_id, id, ts, sender, content from m where conv_id in (select conv_id from big) and not is_system order by ts desc, id desc limit 50",
    "msg_page_keyset": f"with {M}, {BIG} select conv_id, id, ts, sender, content from m where conv_id in (select conv_id from big) and not is_system order by ts desc, id desc limit 50 offset 50",
    "msg_around": f"""with {M}, {BIG}, r as (select conv_id, id, ts, sender from m where conv_id in (select conv_id from big) and not is_system), p as (select quantile_disc(ts, 0.5) as t from r where ts > 0)
select * from (select r.* from r, p where ts <= t order by ts desc, id desc limit 10) union all select * from (select r.* from r, p where ts > t order by ts, id limit 10)""",
    "thread_read": f"with {M}, top as (select conv_id, root_id from ({ROOTS}) order by n desc, conv_id, root_id limit 1) select conv_id, id, root_id, ts, sender from m where (conv_id, root_id) in (select conv_id, root_id from top) and not is_system",
    "thread_summaries": f"with {M} {ROOTS}",
    "conv_stats": f"with {M} select conv_id, count(*) as n, min(ts) filter (ts > 0) as first_ts, max(ts) filter (ts > 0) as last_ts from m where not is_system group by conv_id",
    "coverage_span": f"with {M} select min(ts) as first_ts, max(ts) as last_ts from m where not is_system and ts > 0",
    "browse_search": f"{SEARCH} kind = '1:1'",
    "substring_search": f"{SEARCH} contains(lower(content), 'channel export')",
    "substring_top": f"{SEARCH} contains(lower(content), 'snapshot') order by ts desc, id desc limit 50",
    "exclude_filter": f"{SEARCH} contains(lower(content), 'train') and not contains(lower(content), 'demo') and not contains(lower(content), 'retro')",
    "people_profiles": f"{PEOPLE_FIND} select * from found",
    "people_find_name": f"{PEOPLE_FIND} select * from found where contains(lower(display), 'ro')",
    "call_list": f"{CALL_LIST} select * from found",
    "call_list_participant": f"{CALL_LIST} select * from found where contains(lower(label), 'a')",
    "events_chat_pivot": f"with {M}, {CONV}, {EV} select e.id, e.cid, c.handle, c.msg_count from ev e left join conv c on c.id = e.cid where e.cid is not null",
    "recording_pivot": f"with {M}, {CALLS} select c.id as call_id, recording_link.conversation_id as conv_id, recording_link.linked_message_id as message_id, m.sender from ca c left join m on m.conv_id = recording_link.conversation_id and m.id = recording_link.linked_message_id where recording_link is not null",
    "missing_conversations": f"with {M} select distinct conv_id, {KIND.format('conv_id')} as kind from documents d where conv_id is not null and not exists (select 1 from m where m.conv_id = d.conv_id)",
    "replies_with_root": f"with {M}, r as (select * from m where not is_system) select a.conv_id, a.id, a.root_id, a.ts - b.ts as delay_ms, a.sender = b.sender as to_self from r a join r b on b.conv_id = a.conv_id and b.id = a.root_id where a.root_id <> a.id",
    "coparticipants": f"with {M}, r as (select * from m where not is_system) select sender, count(*) as n from r where not is_mine and conv_id in (select conv_id from r where is_mine) group by sender",
    "people_agg": f"with {M}, {PEOPLE} select * from people",
    "conv_counters": f"with {M}, {CONV} select * from conv",
    "participant_top5": f"with {M}, {PEOPLE}, {ME}, {NAMES} select * from names",
    "self_vote": f"with {M} select sender, count(*) as n from m where is_mine and sender <> '?' group by sender order by n desc, sender limit 1",
    "store_counts": f"with {M}, {PEOPLE}, {PROF}, {EV}, {CALLS} select (select count(*) from m) as messages, (select min(ts) from m where ts > 0) as earliest_ts, (select count(*) from people) as people, (select count(*) from prof) as profiles, (select count(*) from ev) as events, (select count(*) from ca) as calls",
    "handles": f"""with {M}, {PEOPLE}, {CONV}, ids as (select 'c:' as p, id, sha1(id) as h from conv union all select 'p:', mri, sha1(mri) from people),
a as (select *, row_number() over (partition by p, substr(h, 1, 6) order by id) as r6 from ids), b as (select *, case when r6 > 1 then row_number() over (partition by p, substr(h, 1, 7), r6 > 1 order by id) end as r7 from a)
select id, p || substr(h, 1, case when r6 = 1 then 6 when r7 = 1 then 7 else 8 end) as handle from b""",
    "conv_mix": f"with {M}, {CONV} select kind, count(*) as n, sum(msg_count)::bigint as messages from conv where msg_count > 0 group by kind",
    "reactions_total": f"with {M}, {T}, r as (select is_mine, coalesce(list_sum(list_transform(reactions, lambda g: coalesce(len(g.u), 0))), 0) as n from t) select sum(n)::bigint as total, sum(case when is_mine then n else 0 end)::bigint as mine from r",
    "reaction_counts": f"with {M}, r as (select conv_id, id, unnest(reactions) as g from m) select conv_id, id, g.k as key, sum(len(g.u))::bigint as n, min(list_min(list_transform(g.u, lambda x: x.ts))) as first_ts from r where g.k is not null and len(g.u) > 0 group by all",
    "version_fold": f"with {M} select conv_id, id, version, row_no from m",
    "lww_winners": f"select cache_id, entry_key, seq, op_type from ({WIN}) where rn = 1",
    "snapshot_buckets": f"select cache_id, db_id, os_id, entity, count(*) filter (op_type <> 0) as records, max(seq) as max_seq from ({WIN}) where rn = 1 group by all",
    "call_percentiles": f"with {CALLS} select coalesce(direction, '') as direction, quantile_disc(duration_ms, 0.5) as p50, quantile_disc(duration_ms, 0.9) as p90, quantile_disc(duration_ms, 0.99) as p99, round(stddev_pop(duration_ms), 3) as deviation, count(*) as n from ca where duration_ms > 0 group by all",
    "p95_positive": f"""with {M}, {T}, {RHYTHM}, c as (select weekday, slot, sum(n)::bigint as n from rhythm group by all), p as (select weekday, n, row_number() over (partition by weekday order by n, slot) as rn, count(*) over (partition by weekday) as size from c)
select weekday, n as p95 from p where rn = least(size, floor(0.95 * size)::bigint + 1)""",
    "streak_longest": f"""with {M}, {T}, d as (select distinct sender, day from t), i as (select sender, day, day - row_number() over (partition by sender order by day)::int as island from d),
r as (select sender, count(*) as days, min(day) as first_day from i group by sender, island) select sender, max(days) as days, arg_max(first_day, (days, -epoch(first_day))) as first_day from r group by sender""",
    "burst_60s": f"""with {M}, {T}, {TO_ME}, f as (select sender, min((ts, id, conv_id)) as f from to_me group by sender),
r as (select t.sender, t.ts, t.id, t.ts - lag(t.ts) over (partition by t.sender order by t.ts, t.id) as gap from t join f on f.sender = t.sender and t.conv_id = f.f[3] and t.ts >= f.f[1]),
b as (select *, sum(case when gap > 60000 then 1 else 0 end) over (partition by sender order by ts, id rows unbounded preceding) as breaks from r) select sender, count(*) as n, max(ts) as last_ts from b where breaks = 0 group by sender""",
    "bursts_15m": f"""with {M}, r as (select conv_id, id, sender, ts, lag(sender) over w as ps, lag(ts) over w as pt from m where not is_system window w as (partition by conv_id order by ts, id))
select conv_id, id, sender, ts, row_number() over (partition by conv_id order by ts, id) - 1 as burst from r where ps is null or ps <> sender or ts - pt > 900000""",
    "rolling_35d_7d": f"with {M}, {T}, {AXIS} select * from rolling",
    "rolling_4w": f"""with {M}, {T}, {PER_DAY}, {WEEKS}, {RHYTHM}, cells as (select distinct weekday, slot from rhythm)
select a.week, c.weekday, c.slot, round(avg(coalesce(r.n, 0)) over (partition by c.weekday, c.slot order by a.week rows between 3 preceding and current row), 6) as mean_4w from cells c, week_axis a left join rhythm r on r.week = a.week and r.weekday = c.weekday and r.slot = c.slot""",
    "series_collapse": f"""with {EV}, r as (select *, coalesce(series_id, 'single:' || id) as series from ev where not coalesce(is_cancelled, false) and start_ts > 0),
k as (select *, row_number() over w as rn, lead(start_ts) over w as nx, count(*) over (partition by series) as n from r window w as (partition by series order by start_ts, id))
select id, series, start_ts, case when n >= 3 then n - 1 else 0 end as n_more, case when n >= 3 then nx end as next_start from k where n < 3 or rn = 1""",
    "digest_budget": f"""with {M}, th as ({ROOTS}), u as (select *, (sum(case when n <= 5 then n else 4 end) over w)::bigint as used, row_number() over w as rn from th window w as (partition by conv_id order by last_ts desc, root_id desc rows unbounded preceding))
select conv_id, root_id, n, used from u where used <= 40 or rn = 1""",
    "top_per_frame": f"""with {M}, {T}, {AXIS}, r as (select *, row_number() over (partition by day order by sum_35d desc, sender) as rank, max(sum_35d) over (partition by day) as best from rolling)
select day, rank, sender, round(case when best > 0 then sqrt(sum_35d / best) else 0 end, 6) as scale from r where rank <= 10""",
    "lead_interpolation": f"""with {M}, {T}, {PER_DAY}, {WEEKS}, r as (select *, lead(n) over (order by week) as nx from week_axis)
select week, i as step, round(n + coalesce(nx - n, 0) * i / 4.0::double, 6)::double as value from r, unnest(generate_series(0, case when nx is null then 0 else 3 end)) u(i)""",
    "messages_per_day": f"with {M}, {T}, {PER_DAY} select * from per_day",
    "busiest_day": f"with {M}, {T}, {PER_DAY} select day, n from per_day order by n desc, day limit 1",
    "hour_histogram": f"with {M}, {T} select h as hour, count(t.id) as n from generate_series(0, 23) g(h) left join t on hour(tm) = h group by h",
    "night_owls": f"with {M}, {T} select sender, round(avg(case when hour(tm) >= 22 or hour(tm) < 6 then 1 else 0 end), 6) as share, count(*) as n from t group by sender",
    "rhythm_slots": f"with {M}, {T}, {RHYTHM} select * from rhythm",
    "interval_occupancy": f"""with {EV}, {CALLS}, i as (select start_ts, end_ts from ev where not coalesce(is_cancelled, false) and not coalesce(is_all_day, false) and start_ts > 0 union all select start_ts, start_ts + coalesce(duration_ms, 0) from ca where not coalesce(is_deleted, false) and start_ts > 0),
b as (select start_ts // 900000 * 900000 as a, coalesce(end_ts, start_ts) as e from i), x as (select unnest(generate_series(a, greatest(a, least(e - 1, a + 199 * 900000)), 900000)) as ms from b), y as (select make_timestamp(ms * 1000) as tm from x)
select dayofweek(tm) as weekday, {SLOT} as slot, count(*) as n from y group by all""",
    "week_axis": f"with {M}, {T}, {PER_DAY}, {WEEKS} select * from week_axis",
    "gaussian_smoothing": f"""with {M}, {T}, {RHYTHM}, c as (select weekday, slot, sum(n)::double as n from rhythm where slot between 1 and 68 group by all), k as (select a.s as slot, b.s as dst, exp(-power(b.s - a.s, 2) / 8) as w from generate_series(1, 68) a(s), generate_series(1, 68) b(s) where abs(a.s - b.s) <= 6),
norm as (select dst, sum(w) as w from k group by dst) select c.weekday, k.dst as slot, round(sum(k.w * c.n) / any_value(norm.w), 6) as value from c join k on k.slot = c.slot join norm on norm.dst = k.dst group by c.weekday, k.dst""",
    "top_partners": f"""with {M}, {T}, p as (select conv_id, sender, count(*) as n, bool_or(is_mine) as mine from t where kind = '1:1' group by all), v as (select conv_id, sum(n) as volume from p group by conv_id),
o as (select *, row_number() over (partition by conv_id order by n desc, sender) as rn from p where not mine and sender not like '28:%') select sender, sum(volume)::bigint as volume from o join v using (conv_id) where rn = 1 group by sender order by volume desc, sender limit 10""",
    "people_talked_to": f"with {M}, {T} select count(distinct sender) as people from t where not is_mine and sender not like '28:%' and conv_id in (select conv_id from t where is_mine)",
    "first_to_me": f"with {M}, {T}, {TO_ME} select sender, f[1] as ts, f[2] as id from (select sender, min((ts, id)) as f from to_me group by sender)",
    "tokenize": f"with {M}, {IX} select kind, term, count(*) as n from (select kind, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from ix) group by all",
    "fts_postings": f"with {M}, {IX} select term, conv_id, id, count(*) as tf from (select conv_id, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from ix) group by all",
    "fts_bm25": f"""with {M}, {IX}, d as (select conv_id, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as tokens from ix), st as (select count(*) as n, avg(len(tokens)) as avgdl from d),
h as (select conv_id, id, len(tokens) as dl, unnest(list_filter(tokens, lambda x: x in ('channel', 'export'))) as term from d), tf as (select term, conv_id, id, dl, count(*) as tf from h group by all), df as (select term, count(*) as df from tf group by term)
select conv_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join df using (term), st group by conv_id, id having count(*) = 2""",
    "phrases_ngrams": f"with d as (select {TOKENS.format('text')} as tokens from documents where text is not null), g as ({GRAMS.format('', 'd')}) select phrase, count(*) as n from g group by phrase",
    "topics_rank": _topics("true", "(select max(ts) - 30::bigint * 86400000 from r)", "true"),
    "topics_options": _topics("kind = 'channel' and ts < 1770000000000", "1765000000000", "len(list_intersect(string_split(phrase, ' '), ['snapshot', 'index'])) = 0"),
    "topics_scope": f"""with {M}, r as (select ts, sender like '28:%' as bot from m where not is_system and content <> '' and ts > 0), b as (select max(ts) - 30::bigint * 86400000 as since from r where not bot)
select any_value(since) as since, count(*) filter (ts >= since and not bot) as win, count(*) filter (ts < since and not bot) as base, count(*) filter (ts >= since and bot) as bots from r, b""",
    "top_terms": f"""with {M}, {IX}, c as (select kind, term, count(*) as n from (select kind, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from ix) group by all)
select * from (select kind, term, n, row_number() over (partition by kind order by n desc, term) as rank from c) where rank <= 5""",
    "strip_html": f"with {EV} select id, {STRIP.format('body_html')} as text from ev where body_html is not null",
    "url_elide": r"""select doc_id, regexp_replace(text, 'https?://([^\s/<>"]+)(/[^\s<>"]*)?', '[link: \1]', 'gi') as text from documents""",
    "clip": f"select doc_id, {CLIP.format(FLAT.format('text'), 80)} as text from documents",
    "person_names": rf"""with {PROF}, a as (select mri, name, trim(regexp_replace(name, '\([^)]*\)', '', 'g')) as clean, coalesce(given_name, '') as g, coalesce(surname, '') as s, coalesce(type, '') = 'Federated' and trim(coalesce(surname, '')) = '' as fed from prof),
b as (select mri, name, case when fed and contains(clean, ',') then trim(list_extract(string_split(clean, ','), -1)) when fed then clean else g end as given, case when fed and contains(clean, ',') then trim(split_part(clean, ',', 1)) else s end as family from a)
select mri, case when given <> '' and family <> '' then given || ' ' || family else name end as display,
  case when given <> '' and family <> '' then given || ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(family, '\s+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1))), '') else name end as label from b""",
    "json_path_coalesce": "select raw_id, coalesce(" + ", ".join(f"nullif(case when json_type(payload, '{p}') in ('OBJECT') then null else payload ->> '{p}' end, '')" for p in ("$.displayName", "$.subject", "$.threadProperties.topic", "$.imDisplayName", "$.originatorParticipant.displayName")) + ") as label from raw_records",
    "attendee_summary": f"""with {EV}, p as (select id, list_sort(list_transform(list_filter(coalesce(attendees, []), lambda a: coalesce(a.n, a.e) is not null), lambda a: coalesce(a.n, a.e))) as names from ev)
select id, array_to_string(list_slice(names, 1, 3), '; ') as names, greatest(len(names) - 3, 0)::int as more from p""",
    "event_list": EVENT_LIST,
    "event_list_attendee": f"{EVENT_LIST} and len(list_filter(attendees, lambda a: coalesce(contains(lower(a.n), 'elif'), false) or coalesce(contains(lower(a.e), 'elif'), false))) > 0",
    "fingerprints": f"with {FILES} select cache_id, file_no, version, hash from fp",
    "layout_changes": f"""with {FILES}, r as (select *, lag(version) over w as old_version, lag(hash) over w as old_hash from fp window w as (partition by cache_id order by file_no))
select cache_id, file_no, old_version, version as new_version, old_hash <> hash as layout_changed from r where old_hash is not null and (old_hash <> hash or old_version is distinct from version)""",
    "reaction_rows": f"""with {M}, {PEOPLE}, {ME}, r as (select conv_id, id, unnest(reactions) as g from m), f as (select conv_id, id, g.k as key, unnest(g.u) as u from r where g.k is not null and len(g.u) > 0),
k as (select conv_id, id, key, count(*) as n, min(u.ts) filter (u.ts > 0) as first_ts from f group by all), q as (select *, row_number() over (partition by conv_id, id order by n desc, first_ts nulls last, key) as rank from k),
w as (select *, coalesce(u.mri = (select sender from me), false) as own, row_number() over (partition by conv_id, id, key order by coalesce(u.mri = (select sender from me), false) desc, coalesce(u.ts, 0) desc, u.mri) as r from f),
t as (select conv_id, id, key, string_agg(case when own then 'you' else coalesce(nullif(p.name, ''), '(unknown)') end, ', ' order by r) as who from w left join people p on p.mri = w.u.mri where r <= 3 group by all)
select conv_id, id, rank, key, n, case when rank <= 3 then who || case when n > 3 then ' +' || (n - 3) else '' end when rank <= 5 then n::varchar else 'folded' end as shown from q join t using (conv_id, id, key)""",
    "thread_blocks": f"""with {M}, r as (select *, count(*) over (partition by conv_id, root_id) as n, row_number() over (partition by conv_id, root_id order by ts desc, id desc) as e from m where not is_system)
select conv_id, root_id, id, n, n - count(*) over (partition by conv_id, root_id) as earlier from r where n <= 5 or id = root_id or e <= 3""",
    "call_durations": f"with {CALLS}, s as (select id, duration_ms as d, duration_ms // 1000 as s from ca) select id, case when d is null or d <= 0 then '' when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' else s // 3600 || 'h' || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm' end as shown from s",
    "body_chunks": "select doc_id, substr(text, 201, 300) as chunk from documents",
    "p6_pending_ranges": f"with p as ({P6}), i as (select cache_id, seq, seq - row_number() over (partition by cache_id order by seq) as g from p) select cache_id, min(seq) as lo, max(seq) as hi from i group by cache_id, g",
    "incremental_equals_full": "select cache_id, entry_key from store_entries where false",
}

SQL["fts_bm25_scoped"] = f"select b.* from ({SQL['fts_bm25']}) b join (with {M} select * from m where kind = 'channel' and ts >= 1760000000000 and ts < 1770000000000) s using (conv_id, id)".replace("b.* from", "b.conv_id, b.id, b.score from")

_TOP = "bigc as (select id from conv order by msg_count desc, id limit 1), bigp as (select mri from people order by msg_count desc, mri limit 1)"
_LONGEST = f"th as ({ROOTS}), tt as (select conv_id, root_id, n from th order by n desc, conv_id, root_id limit 1), tr as (select m.id, m.ts, m.sender, row_number() over (order by m.ts, m.id) - 1 as place from m join tt using (conv_id, root_id) where not is_system and m.id <> m.root_id)"
SQL |= {
    "search_scoped": f"with {M}, {PEOPLE}, {CONV}, {_TOP} select conv_id, id, ts, sender, {SNIP} as snippet from m where not is_system and conv_id = (select id from bigc) and sender <> (select mri from bigp) and contains(lower(content), 'the') and not contains(lower(content), 'snapshot') and ts >= 1760000000000 and ts < 1768000000000",
    "search_sender": f"with {M}, {PEOPLE}, {CONV}, {_TOP} select conv_id, id, ts, sender, {SNIP} as snippet from m where not is_system and sender = (select mri from bigp) and mentions_me",
    "search_misses": "select * from (values ('c:zzzzzz', 'no-such-conversation'), ('p:zzzzzz', 'no-such-sender'), ('-c:zzzzzz', 'no-such-excluded-conversation'), ('-p:zzzzzz', 'no-such-excluded-person'), ('m:zzzzzz', 'no-such-message')) t(selector, reason)",
    "coverage_scoped": f"with {M}, {PEOPLE}, {CONV}, {_TOP} select min(ts) as first_ts, max(ts) as last_ts, count(*) as n from m where not is_system and ts > 0 and conv_id = (select id from bigc)",
    "page_cursor": f"with {M}, {BIG}, p as (select *, row_number() over (order by ts desc, id desc) as rn from m where conv_id = (select conv_id from big) and not is_system) select conv_id, id, ts, sender, content from p where rn between 51 and 100",
    "thread_window": f"with {M}, {_LONGEST}, hit as (select place from tr, tt where place = n // 2), st as (select greatest(0, place - 2) as s from hit) select place, id, ts, sender from tr, st where place >= s and place < s + 4 union all select -1, m.id, m.ts, m.sender from m join tt using (conv_id, root_id) where m.id = m.root_id and not is_system",
    "people_total": f"{PEOPLE_FIND} select mri, count(*) over () as total from found where contains(lower(display), 'ro') order by msg_count desc, mri limit 3",
    "max_event_start": f"with {EV} select coalesce(max(start_ts), 0) as max_start from ev",
    "events_ahead": f"{EVENT_LIST} and start_ts >= 1765000000000 and start_ts < 1765000000000 + 7 * 86400000",
    "calls_filtered": f"""with {CALLS} select id, call_type, direction, state, start_ts, duration_ms, array_to_string(list_slice(list_sort(list_filter(list_transform(coalesce(participants, []), lambda p: p.name), lambda n: coalesce(n, '') <> '')), 1, 4), ', ') as title
from ca where not coalesce(is_deleted, false) and lower(direction) = 'incoming' and start_ts >= 1750000000000 and duration_ms >= 1000""",
    "known_conversations": f"""with {M}, {CONV}, {EV}, {CALLS}, meta as (select id, max(t) as t from (select cid as id, start_ts as t from ev where cid is not null union all select group_thread_id, start_ts from ca where group_thread_id is not null) group by id)
select coalesce(c.id, k.id) as id, coalesce(msg_count, 0) as msg_count, greatest(coalesce(last_ts, 0), coalesce(k.t, 0)) as last_ts, c.id is not null as stored from conv c full join meta k on k.id = c.id""",
    "first_message": f"""with {M}, {T}, {TO_ME}, f as (select min((ts, id, conv_id, sender)) as f from to_me), h as (select t.*, f.f as k from t, f where t.conv_id = f.f[3] and (t.ts, t.id) >= (f.f[1], f.f[2])),
o as (select min((ts, id)) as o from h where sender <> k[4]), own as (select h.*, case when ts - lag(ts) over (order by ts, id) > 60000 then 1 else 0 end as b from h, o where sender = k[4] and (o.o is null or (ts, id) < o.o)),
r as (select *, sum(b) over (order by ts, id rows unbounded preceding) as breaks from own) select any_value(k[3]) as conv_id, any_value(k[2]) as id, any_value(k[1]) as ts, any_value(k[4]) as sender, coalesce(string_agg(content, chr(10) order by ts, id) filter (trim(content) <> ''), '') as text, count(*) as n from r where breaks = 0""",
    "span_anchors": f"with {M}, {T} select min(ts) filter (kind in ('1:1', 'group', 'meeting', 'channel') and trim(content) <> '' and (is_mine or kind <> 'channel')) as first_ts, max(ts) as last_ts from t",
    "scale_pick": f"""with {M}, {T}, {PER_DAY}, p as (select n, row_number() over (order by n) as rn, count(*) over () as size from per_day), l as (select max(n) as top, max(size) as size, max(n) filter (rn = floor(size * 0.1) + 1) as low from p)
select case when size < 2 or log10(top / greatest(1, low)) < 1 then 'linear' when log10(top / greatest(1, low)) < 2 then 'sqrt' else 'symlog' end as scale, top from l""",
    "half_year": f"with {M}, {T}, sp as (select min(ts) filter (kind in ('1:1', 'group', 'meeting', 'channel') and trim(content) <> '' and (is_mine or kind <> 'channel')) as a, max(ts) as b from t), st as (select greatest(coalesce(a, 0), b - 182::bigint * 86400000) as s from sp) select day, count(*) as n from t, st where ts >= s and ts <= s + 182::bigint * 86400000 group by day",
}
