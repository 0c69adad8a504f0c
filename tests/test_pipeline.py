import pyarrow as pa
import pytest
from conftest import rows

from threadlake.operators import changefeed
from threadlake.plans import mapping as mp
from threadlake.plans.refresh import VersionedStore
from threadlake.sources import clone, indexeddb, leveldb
from threadlake.sources.leveldb import Entry
from threadlake.streaming import changes

ME, YOU = "8:orgid:me", "8:orgid:you"
STORES = {1: ("conversation-manager:x", 1, "conversations"), 2: ("replychain-manager:x", 1, "replychains"), 3: ("profile-manager:x", 1, "profiles"), 4: ("calendar-manager:x", 1, "calendar"), 5: ("call-history-manager:x", 1, "call-history")}


def stored(value):
    return leveldb.to_varint(1) + b"\xff\x11\x02" + pa.compress(clone.encode(value), codec="snappy", asbytes=True)


def rec(db, n):
    return indexeddb.to_prefix(db, 1, 1) + b"\x01" + bytes([n])


def message(i, text, by, **more):
    return {"id": str(i), "type": "Message", "conversationId": "19:abc@thread.v2", "version": i, "originalArrivalTime": 1_700_000_000_000 + i, "creator": by, "imDisplayName": by[-3:], "messageType": "RichText/Html", "content": text, "isSentByCurrentUser": by == ME} | more


def base():
    out = []
    for db, (name, store, label) in STORES.items():
        out.append((indexeddb.to_prefix(0, 0, 0) + bytes([indexeddb.DB_NAME]) + indexeddb.to_text("o") + indexeddb.to_text(name), leveldb.to_varint(db)))
        out.append((indexeddb.to_prefix(db, 0, 0) + bytes([indexeddb.STORE_META]) + leveldb.to_varint(store) + b"\0", label.encode("utf-16-be")))
    out += [
        (rec(1, 1), stored({"id": "19:abc@thread.v2", "threadProperties": {"topic": "", "spaceThreadTopic": "Plans"}, "type": "Chat", "lastMessageTimeUtc": 5})),
        (rec(2, 1), stored({"messageMap": {"a": message(10, "<p>Hi&nbsp;<b>you</b></p>", ME), "b": message(11, "yo", YOU, parentMessageId="10", properties={"mentions": '[{"mri":"%s"}]' % ME, "emotions": [{"key": "like", "users": [{"mri": "z", "time": 2}, {"mri": "a", "time": 1}]}, {"key": "x", "users": []}]}), "c": message(10, "old", ME, version=9), "d": {"id": "12", "type": "Other"}}})),
        (rec(3, 1), stored({"mri": YOU, "displayName": "Doe, Jo (Org)", "givenName": "jo@x.example", "type": "Federated"})),
        (rec(4, 1), stored({"objectId": "e1", "startTime": "2025-01-01T10:00:00.000Z", "endTime": 1735729200000, "attendees": [{"name": "R", "type": "Resource"}, {"name": "B", "address": "b@x", "status": {"response": "Accepted"}}, {"name": "A"}], "isOnlineMeeting": True})),
        (rec(4, 2), stored({"objectId": "m1", "eventType": "RecurringMaster"})),
        (rec(5, 1), stored({"callId": "c1", "callType": "TwoParty", "callDirection": "Outgoing", "callState": "Missed", "startTime": "2025-01-01T10:00:00Z", "durationInMs": 5, "originatorParticipant": {"id": ME}, "targetParticipant": {"id": YOU}, "recordings": [{"linkedMessage": {"conversationId": "c", "linkedMessageId": "m"}}]})),
        (rec(5, 2), stored({"callId": "c2", "callType": "TwoParty", "callDirection": "Outgoing", "callState": "Accepted", "startTime": "2025-01-01T10:00:00Z", "durationInMs": 5, "originatorParticipant": {"id": ME}, "targetParticipant": {"id": YOU}, "recordings": [{"linkedMessage": {"conversationId": "c", "linkedMessageId": "m"}}]})),
    ]
    return out


@pytest.fixture
def cache(tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    (folder / "000001.ldb").write_bytes(leveldb.write_table(Entry(k, v, i + 1, 1) for i, (k, v) in enumerate(base())))
    return folder


def test_shapes_and_refresh(spark, cache, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    first = store.refresh(str(cache))
    assert (first.outcome, first.lossy) == ("swapped", False) and store.meta()["matched"]
    m = {r.id: r for r in store.table("message").collect()}
    assert set(m) == {"10", "11"} and m["10"].content == "Hi you" and m["10"].is_mine and m["10"].root_id == "10"
    assert m["11"].mentions_me and m["11"].root_id == "10" and [(g.k, [u.mri for u in g.u]) for g in m["11"].reactions] == [("like", ["a", "z"])]
    assert store.table("conversation").first().topic == "Plans"
    p = store.table("profile").first()
    assert (p.given_name, p.surname) == ("Jo", "Doe")
    e = store.table("event").collect()
    assert [(x.id, x.kind, x.start_ts, [a.n for a in x.attendees]) for x in e] == [("e1", "meeting", 1735725600000, ["A", "B"])]
    c = store.table("call").filter("id = 'c1'").first()
    assert c.is_missed and c.counterpart_mri == YOU and c.recording_link.linked_message_id == "m"

    assert store.refresh(str(cache)).outcome == "fresh"
    pinned = store.meta()
    (cache / "000002.log").write_bytes(leveldb.write_log([(100, [(rec(2, 1), stored({"messageMap": {"a": message(10, "edited", ME, version=99)}})), (rec(5, 1), None)])]))
    second = store.refresh(str(cache))
    assert (second.outcome, second.max_seq, second.parsed, second.touched) == ("inplace", 101, ("000002.log",), 2)
    assert [r.id for r in store.table("call").collect()] == ["c2"] and [r.content for r in store.table("message").collect()] == ["edited"]
    assert store.table("message", pinned).count() == 2
    inplace = {n: rows(store.table(n)) for n in store.meta()["tables"]}
    assert store.refresh(str(cache), full=True).outcome == "swapped"
    assert {n: rows(store.table(n)) for n in store.meta()["tables"]} == inplace

    (cache / "000003.ldb").write_bytes(b"damaged")
    kept = store.refresh(str(cache))
    assert (kept.outcome, kept.lossy) == ("skipped", True)
    cold = VersionedStore(spark, str(tmp_path / "cold"))
    assert cold.refresh(str(cache)).lossy and cold.table("message").count() == 1


def test_mapping_choice_and_proposal():
    assert mp.choose([mp.V1], "x", {"replychains", "conversations", "more"}) == (mp.V1, False)
    assert mp.choose([mp.V1], "x", {"replychains"}) == (None, False)
    assert mp.propose({"msgs": {"content", "creator", "version", "q"}, "conversations": {"id", "type"}, "junk": {"a"}}) ["message"]["store"] == "msgs"
    got = mp.propose({"msgs": {"content", "creator", "version", "q"}, "chats": {"id", "type", "threadProperties"}, "junk": {"a"}})
    assert got["message"]["fields"] == {"version": "version", "sender": "creator", "content": "content"} and got["conversation"]["store"] == "chats" and got["conversation"]["fields"]["topic"] == "threadProperties.topic"


def test_incremental_equals_full(spark, cache, tmp_path):
    """Adds, edits, moves between chains, deletes, a vanished and a compacted file: in place gives what a full build gives, and parses only what is new."""
    store = VersionedStore(spark, str(tmp_path / "store"))
    assert store.refresh(str(cache)).parsed == ("000001.ldb",)
    assert {r.term for r in store.postings().collect()} == {"hi", "you", "yo"}
    orphan = {"id": "19:zzz@thread.v2", "threadProperties": {"topic": "Gone soon"}, "type": "Chat", "lastMessageTimeUtc": 7}
    steps = [
        ("000002.log", [(100, [(rec(2, 2), stored({"messageMap": {"a": message(20, "new words", YOU, conversationId="19:def@thread.v2"), "b": message(11, "moved", YOU, version=50)}})), (rec(3, 2), stored({"mri": ME, "displayName": "Me Myself", "givenName": "Me", "type": "User"})), (rec(1, 2), stored(orphan))])], {"000002.log"}),
        ("000003.log", [(200, [(rec(2, 1), stored({"messageMap": {"b": message(11, "back", YOU, version=60)}})), (rec(5, 2), None), (rec(1, 2), None), (rec(2, 2), None)])], {"000003.log"}),
    ]
    for name, batches, parsed in steps:
        (cache / name).write_bytes(leveldb.write_log(batches))
        out = store.refresh(str(cache))
        assert out.outcome == "inplace" and set(out.parsed) == parsed
    other = VersionedStore(spark, str(tmp_path / "full"))
    assert other.refresh(str(cache)).outcome == "swapped"
    other.postings()
    for t in store.meta()["tables"]:
        assert rows(store.table(t)) == rows(other.table(t).select(store.table(t).columns)), t
    assert [r.content for r in store.table("message").collect()] == ["back"] and [r.id for r in store.table("all_conversations").collect()] == ["19:abc@thread.v2"]
    # A vanished file takes its entries with it: what they replaced is live again.
    (cache / "000003.log").unlink()
    out = store.refresh(str(cache))
    assert out.outcome == "inplace" and out.parsed == () and {r.content for r in store.table("message").collect()} == {"Hi you", "moved", "new words"}
    assert store.refresh(str(cache), wait=True).outcome == "waiting"


def test_inspect_and_memory(spark, cache, tmp_path):
    from threadlake.sources.datasource import memory_rows

    found = VersionedStore(spark, str(tmp_path / "none")).inspect(str(cache))
    assert found["mapping"] == "1.0.0" and not found["lossy"] and found["health"]["message"] == {"entity": "message", "records": 1, "undecoded": 0, "items": 4, "kept": 3}
    (cache / "CURRENT").write_text("MANIFEST-000001")
    store = VersionedStore(spark, str(tmp_path / "live"))
    assert store.follow(str(cache), str(tmp_path / "copy")).outcome == "swapped" and store.follow(str(cache), str(tmp_path / "copy")).outcome == "fresh"
    held = memory_rows(spark, {"000001.ldb": (cache / "000001.ldb").read_bytes(), "000009.log": b""})
    assert mp.winners(held).count() == len(base()) and held.filter("rec_kind = 'status'").count() == 2


def test_stream_keeps_the_table_of_the_batch(spark, tmp_path):
    schema = "cache_id long, seq long, op_type int, entry_key string, version string"
    parts = [[(1, 5, 1, "a", "2"), (1, 7, 0, "b", None), (1, 9, 1, "c", "1")], [(1, 6, 1, "b", "9"), (1, 8, 1, "a", "1"), (1, 10, 0, "c", None)], [(1, 11, 1, "b", None), (1, 8, 1, "a", "1")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = changes.apply_feed(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    got = changefeed.live_records(spark.read.parquet(str(last))).select("cache_id", "entry_key", "seq")
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert rows(got) == rows(changefeed.live_records(whole).select("cache_id", "entry_key", "seq")) == [(1, "a", 5), (1, "b", 11)]


def test_stream_sessions(spark, tmp_path):
    data = [("c", "1", "8:a", 1_000_000, False), ("c", "1", "8:a", 1_000_000, False), ("c", "2", "8:A ", 1_500_000, False), ("c", "3", "8:a", 9_000_000, False), ("c", "4", "8:b", 500_000_000, False), ("c", "5", "8:a", 1_000_500, True)]
    spark.createDataFrame(data, "conv_id string, id string, sender_mri string, ts long, is_system boolean").coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("conv_id string, id string, sender_mri string, ts long, is_system boolean").parquet(str(tmp_path / "m"))
    q = changes.session_counts(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.sender, r.n) for r in spark.table("sessions").collect()) == [("8:a", 1), ("8:a", 2)]
