"""The sampled raw records of all caches through the binary format, the mapping and the shapes."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.fold import latest
from threadlake.plans import mapping as mp
from threadlake.plans import shape
from threadlake.sources import clone, leveldb
from threadlake.sources.datasource import file_rows
from threadlake.sources.indexeddb import to_prefix
from threadlake.tables import table

#: Stores of the sampled records by entity; their messages lie in records of their own.
STORES = {"conversation": "conversations", "message": "replychains", "profile": "profiles", "event": "calendar", "call": "call-history"}


def records(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The latest record of each key of an entity's stores, over all caches and files, mapped to the entity's fields."""
    rows = table(spark, root, "raw_records").filter((F.col("store") == STORES[name]) & F.col("cache_id").isNotNull() & F.col("rec_key").isNotNull() & F.col("payload").isNotNull())
    kept = latest(rows.select("cache_id", "rec_key", "file_no", "raw_id", "payload"), ["cache_id", "rec_key"], [F.col("file_no"), F.col("raw_id")])
    live = kept.select(F.encode(F.concat_ws("|", "cache_id", "rec_key"), "utf-8").alias("entry_key"), F.col("raw_id").alias("seq"), F.lit("record").alias("rec_kind"), F.lit(1).alias("db_id"), F.lit(1).alias("os_id"), F.col("payload").alias("value"))
    entity = dataclasses.replace(mp.V1.entities[name], iterate=None, keep=None)
    return mp.extract(live, entity, [Row(store=STORES[name], db=entity.db.replace("*", "x"), db_id=1, os_id=1)])


def conversations(spark: SparkSession, root: str) -> DataFrame:
    return shape.conversations(records(spark, root, "conversation"))


def profiles(spark: SparkSession, root: str) -> DataFrame:
    return shape.profiles(records(spark, root, "profile"))


def events(spark: SparkSession, root: str) -> DataFrame:
    return shape.events(records(spark, root, "event")).select("id", "kind", "subject", "start_ts", "end_ts", "is_all_day", "location", "cid", "is_cancelled", "is_confidential", "has_attach")


def calls(spark: SparkSession, root: str) -> DataFrame:
    return shape.calls(records(spark, root, "call")).select("id", "call_type", "direction", "state", "is_missed", "start_ts", "duration_ms", "counterpart_mri", "has_recording", "is_deleted")


def messages(spark: SparkSession, root: str) -> DataFrame:
    return shape.messages(records(spark, root, "message")).select("conv_id", "id", "version", "ts", "sender_mri", "sender_name", "kind", "is_mine", "is_system", "root_id")


def _through_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch is written as a table and as a log, both are read back; raw_ids of records that come back otherwise."""
    import json

    for batch in batches:
        given: dict[int, object] = {}
        for raw_id, text in zip(batch.column("raw_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            try:
                given[raw_id] = json.loads(text)
            except (TypeError, ValueError):
                continue
        keyed = [(to_prefix(1, 1, 1) + b"\x01" + raw_id.to_bytes(8), leveldb.to_varint(1) + b"\xff\x11\x02" + pa.compress(clone.encode(v), codec="snappy", asbytes=True)) for raw_id, v in sorted(given.items())]
        files = {"1.ldb": leveldb.write_table(leveldb.Entry(k, v, n, 1) for n, (k, v) in enumerate(keyed, 1)), "2.log": leveldb.write_log([(1, keyed)])}
        wrong = []
        for name, data in files.items():
            back = {int.from_bytes(r[9][-8:]): r for r in file_rows(name, 0, data) if r[5] == "record"}
            wrong += [i for i, v in given.items() if i not in back or back[i][11] is None or json.loads(back[i][11]) != v]
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(wrong)), pa.int64())], names=["raw_id"])


def round_trip(spark: SparkSession, root: str) -> DataFrame:
    """raw_id of records that don't survive being written to the binary format (tables and logs, blocks, checksums, compression, clones) and read: none."""
    return table(spark, root, "raw_records").select("raw_id", "payload").mapInArrow(_through_files, "raw_id long")


QUERIES = {"shape_conversations": conversations, "shape_profiles": profiles, "shape_events": events, "shape_calls": calls, "shape_messages": messages, "store_round_trip": round_trip}

_MS = "coalesce(try_cast({0} as double)::bigint, epoch_ms(try_cast({0} as timestamptz)), 0)"
_KIND = "case when {0} like '%@unq.gbl.spaces%' then '1:1' when {0} like '%meeting\\_%' escape '\\' then 'meeting' when {0} like '%@thread.v2%' then 'group' when {0} like '%@thread.skype%' or {0} like '%@thread.tacv2%' then 'channel' else 'other' end"


def _base(name: str, key: str, fields: dict[str, str]) -> str:
    """The mapped fields of the latest records, then the last row of each key."""
    columns = ", ".join("coalesce(" + ", ".join(f"nullif(payload ->> '$.{p}', '')" for p in paths.split()) + f") as {f}" for f, paths in fields.items())
    return f"""with k as (select *, row_number() over (partition by cache_id, rec_key order by file_no desc, raw_id desc) as rn from raw_records where store = '{STORES[name]}' and cache_id is not null and rec_key is not null and payload is not null),
f as (select raw_id, lower(hex(encode(cache_id || '|' || rec_key))) as record_key, {columns} from k where rn = 1),
l as (select *, row_number() over (partition by {key} order by raw_id desc) as last from f)"""


SQL = {
    "shape_conversations": f"""{_base("conversation", "id", {"id": "id", "topic": "threadProperties.topic threadProperties.spaceThreadTopic", "thread_type": "threadProperties.threadType", "type": "type", "team_id": "teamId", "last_time": "lastMessageTimeUtc"})}
select id, {_KIND.format('id')} as kind, topic, team_id, coalesce(thread_type, type) as thread_type, {_MS.format('last_time')} as meta_last_ts from l where last = 1 and id is not null""",
    "shape_profiles": f"""{_base("profile", "mri, name is null", {"mri": "mri", "name": "displayName", "given_name": "givenName", "surname": "surname", "type": "type", "org": "tenantName"})}
select mri, name, coalesce(given_name, '') as given_name, coalesce(surname, '') as surname, coalesce(type, 'None') as type, coalesce(org, '') as org from l where last = 1 and mri is not null and name is not null""",
    "shape_events": f"""{_base("event", "coalesce(id, record_key), coalesce(event_type, '') = 'RecurringMaster'", {"id": "objectId", "subject": "subject", "start": "startTime", "stop": "endTime", "all_day": "isAllDayEvent", "location": "location", "online": "isOnlineMeeting", "cid": "skypeTeamsDataObject.cid", "cancelled": "isCancelled", "event_type": "eventType", "label": "sensitivityLabelId", "no_forward": "doNotForward", "attach": "hasAttachments"})}
select coalesce(id, record_key) as id, case when coalesce(contains(cid, '19:meeting_'), false) or coalesce(lower(online) = 'true', false) then 'meeting' else 'appointment' end as kind, subject, {_MS.format('start')} as start_ts, {_MS.format('stop')} as end_ts, coalesce(lower(all_day) = 'true', false) as is_all_day,
location, case when contains(cid, '19:meeting_') then cid end as cid, coalesce(lower(cancelled) = 'true', false) as is_cancelled, coalesce(lower(label) not in ('false', '0', ''), false) or coalesce(lower(no_forward) = 'true', false) as is_confidential, coalesce(lower(attach) = 'true', false) as has_attach
from l where last = 1 and coalesce(event_type, '') <> 'RecurringMaster'""",
    "shape_calls": f"""{_base("call", "coalesce(id, record_key)", {"id": "callId", "call_type": "callType", "direction": "callDirection", "state": "callState", "start": "startTime", "duration": "durationInMs", "originator": "originatorParticipant.id", "target": "targetParticipant.id", "recordings": "recordings", "deleted": "isDeleted"})}
select coalesce(id, record_key) as id, call_type, direction, state, coalesce(state = 'Missed', false) as is_missed, {_MS.format('start')} as start_ts, coalesce(try_cast(duration as bigint), 0) as duration_ms, case when direction = 'Outgoing' then target else originator end as counterpart_mri,
coalesce(starts_with(recordings, '[') and recordings <> '[]', false) as has_recording, coalesce(lower(deleted) = 'true', false) as is_deleted from l where last = 1""",
    "shape_messages": f"""{_base("message", "conv_id, id", {"id": "id", "conv_id": "conversationId", "parent": "parentMessageId", "version": "version", "at_": "originalArrivalTime composeTime clientArrivalTime", "sender": "creator", "sender_name": "imDisplayName", "type": "type", "message_type": "messageType", "sent_by_me": "isSentByCurrentUser"})},
me as (select sender from f where lower(sent_by_me) = 'true' and sender is not null group by sender order by count(*) desc, sender limit 1),
v as (select *, coalesce(try_cast(version as bigint), 0) as vn, {_MS.format('at_')} as t from f where conv_id is not null),
w as (select *, row_number() over (partition by conv_id, id order by vn desc, raw_id desc, record_key desc) as r from v)
select conv_id, id, vn as version, case when t <> 0 then t else coalesce(try_cast(id as bigint), 0) end as ts, coalesce(sender, '?') as sender_mri, coalesce(sender_name, '') as sender_name, {_KIND.format('conv_id')} as kind,
coalesce(lower(sent_by_me) = 'true', false) or coalesce(sender = (select sender from me), false) as is_mine, coalesce(type, 'Message') <> 'Message' or coalesce(regexp_matches(message_type, '(?i)^ThreadActivity/|Control|Event|SystemMessage'), false) as is_system,
case when parent is not null and parent is distinct from id then parent else id end as root_id from w where r = 1""",
    "store_round_trip": "select raw_id from raw_records where false",
}
