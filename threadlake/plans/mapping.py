"""From bronze entries (the data source's rows) to the records of each entity, by a mapping of fields to paths."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping as Map
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.snapshot import normal_db


@dataclass(frozen=True)
class Entity:
    """Where an entity's records lie: databases by pattern, a store, a container to iterate, a test, and paths by field."""

    db: str
    store: str
    fields: Map[str, tuple[str, ...]]
    iterate: str | None = None
    keep: tuple[str, str] | None = None


@dataclass(frozen=True)
class Mapping:
    version: str
    hashes: frozenset[str]
    stores: frozenset[str]
    entities: Map[str, Entity] = field(default_factory=dict)


#: Stores and field names of the first layout. It is known by its stores; fingerprints of layouts that were looked at may be added.
V1 = Mapping(
    "1.0.0",
    frozenset(),
    frozenset(["replychains", "conversations"]),
    {
        "conversation": Entity("*conversation-manager*", "conversations", {"id": ("id",), "topic": ("threadProperties.topic", "threadProperties.spaceThreadTopic"), "thread_type": ("threadProperties.threadType",), "type": ("type",), "team_id": ("teamId",), "last_time": ("lastMessageTimeUtc",)}),
        "message": Entity(
            "*replychain-manager*",
            "replychains",
            {"id": ("id",), "conv_id": ("conversationId",), "parent": ("parentMessageId",), "version": ("version",), "time": ("originalArrivalTime", "composeTime", "clientArrivalTime"), "sender": ("creator",), "sender_name": ("imDisplayName",), "type": ("type",), "message_type": ("messageType",), "content": ("content",), "sent_by_me": ("isSentByCurrentUser",), "mentions": ("properties.mentions",), "files": ("properties.files", "files"), "cards": ("properties.cards", "cards"), "attachments": ("properties.attachments", "attachments"), "reactions": ("properties.emotions",)},
            iterate="messageMap",
            keep=("type", "Message"),
        ),
        "profile": Entity("*profile*", "profiles", {"mri": ("mri",), "name": ("displayName",), "given_name": ("givenName",), "surname": ("surname",), "type": ("type",), "org": ("tenantName",)}),
        "event": Entity(
            "*calendar*",
            "calendar",
            {"id": ("objectId",), "series_id": ("seriesMasterId",), "subject": ("subject",), "start": ("startTime",), "end": ("endTime",), "all_day": ("isAllDayEvent",), "location": ("location",), "organizer_name": ("organizerName",), "organizer_email": ("organizerAddress",), "online": ("isOnlineMeeting",), "cid": ("skypeTeamsDataObject.cid",), "my_response": ("myResponseType",), "show_as": ("showAs",), "cancelled": ("isCancelled",), "event_type": ("eventType",), "label": ("sensitivityLabelId",), "no_forward": ("doNotForward",), "has_attach": ("hasAttachments",), "attendees": ("attendees",), "body_html": ("bodyContent",)},
        ),
        "call": Entity(
            "*call-history-manager*",
            "call-history",
            {"id": ("callId",), "call_type": ("callType",), "direction": ("callDirection",), "state": ("callState",), "start": ("startTime",), "duration": ("durationInMs",), "originator": ("originatorParticipant.id",), "target": ("targetParticipant.id",), "participants": ("participantList",), "group_thread_id": ("groupChatThreadId",), "recordings": ("recordings",), "transcript": ("transcript",), "voicemail": ("voicemailMetadata",), "spam_level": ("spamRiskLevel",), "user_part": ("isCurrentUserPartOfCall",), "deleted": ("isDeleted",)},
        ),
    },
)


def winners(bronze: DataFrame, cap: int | None = None) -> DataFrame:
    """Live entries: the highest seq per key (equal: the first in canonical order), deletes dropped."""
    rows = bronze.filter("rec_kind <> 'status'")
    if cap is not None:
        rows = rows.filter(F.col("seq") <= cap)
    w = W.partitionBy("entry_key").orderBy(F.desc("seq"), F.col("file").endswith(".log"), "file", "entry_ord")
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1 and op_type <> 0").drop("_rank")


def is_lossy(bronze: DataFrame) -> bool:
    return bool(bronze.filter("rec_kind = 'status'").agg(F.bool_or("lossy").alias("x")).first()["x"])


def catalog(live: DataFrame) -> DataFrame:
    """db_id, os_id, db, store: the names of all stores. A row per store."""
    dbs = live.filter("rec_kind = 'db_name' and db_id is not null").select("db_id", F.col("name").alias("db")).distinct()
    stores = live.filter("rec_kind = 'store_name'").select("db_id", "os_id", F.col("name").alias("store")).distinct()
    return stores.join(dbs, "db_id")


def layout_hash(live: DataFrame, sample: int = 5) -> str:
    """The layout's fingerprint: names of databases (normalised), stores and top-level fields of ``sample`` records each."""
    w = W.partitionBy("db_id", "os_id").orderBy("entry_key")
    few = live.filter("rec_kind = 'record' and value is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample)
    fields = few.select("db_id", "os_id", F.explode(F.json_object_keys("value")).alias("f")).groupBy("db_id", "os_id").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("fields"))
    rows = catalog(live).join(fields, ["db_id", "os_id"], "left").select(F.concat_ws("|", normal_db(F.col("db")), "store", F.coalesce("fields", F.lit(""))).alias("line"))
    row = rows.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ";"), 256), 1, 16).alias("h")).first()
    return row["h"]


def choose(mappings: list[Mapping], hash_: str, stores: set[str]) -> tuple[Mapping | None, bool]:
    """(mapping, whether its hash is known): by hash, else the first whose stores are all there, else none."""
    for m in mappings:
        if hash_ in m.hashes:
            return m, True
    return next(((m, False) for m in mappings if m.stores <= stores), (None, False))


def _of(live: DataFrame, entity: Entity, names: list[Row] | None = None) -> Column:
    """Whether a row lies in the entity's stores."""
    at = F.lit(False)
    for r in catalog(live).collect() if names is None else names:  # one row per store of the layout
        if r.store == entity.store and fnmatch.fnmatchcase(r.db, entity.db):
            at = at | ((F.col("db_id") == r.db_id) & (F.col("os_id") == r.os_id))
    return at


def health(live: DataFrame, mapping: Mapping) -> DataFrame:
    """entity, records, undecoded (records whose value can't be read), items (of containers), kept (items that pass the entity's test). A row per entity."""
    parts, names = [], catalog(live).collect()
    for name, entity in sorted(mapping.entities.items()):
        own = live.filter(_of(live, entity, names) & (F.col("rec_kind") == "record"))
        counts = own.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("value").isNull()).alias("undecoded"))
        items = F.size(F.map_values(F.from_json(F.get_json_object("value", f"$.{entity.iterate}"), "map<string,string>"))) if entity.iterate else F.lit(1)
        counts = counts.withColumn("items", F.lit(own.filter("value is not null").agg(F.coalesce(F.sum(items), F.lit(0)).cast("long").alias("n")).first()["n"]))
        parts.append(counts.select(F.lit(name).alias("entity"), "records", "undecoded", F.col("items").cast("long").alias("items"), F.lit(extract(live, entity, names).count()).cast("long").alias("kept")))
    return reduce(DataFrame.unionByName, parts)


def extract(live: DataFrame, entity: Entity, names: list[Row] | None = None) -> DataFrame:
    """record_key, item_ord and one string column per field: the first path that is neither null nor ''. ``names``: the rows of the catalog, where they are known already or ``live`` holds a part only."""
    at = _of(live, entity, names)
    rows = live.filter(at & (F.col("rec_kind") == "record") & F.col("value").isNotNull()).select(F.lower(F.hex("entry_key")).alias("record_key"), F.col("seq"), "value")
    if entity.iterate:
        items = F.from_json(F.get_json_object("value", f"$.{entity.iterate}"), "map<string,string>")
        rows = rows.select("record_key", "seq", F.posexplode(F.map_values(items)).alias("item_ord", "value"))
    else:
        rows = rows.withColumn("item_ord", F.lit(0))
    if entity.keep:
        rows = rows.filter(F.get_json_object("value", f"$.{entity.keep[0]}") == entity.keep[1])
    return rows.select("record_key", "seq", "item_ord", *[F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{p}"), F.lit("")) for p in paths]).alias(f) for f, paths in entity.fields.items()])


def propose(fields: Map[str, set[str]], known: Mapping = V1) -> dict[str, dict]:
    """For an unknown layout: by entity, the store whose fields most look like it and a map of the entity's fields to paths that are there.

    ``fields`` has the paths of each store (those of a container's items for what is iterated). A store is proposed once,
    to the entity it shares most fields with (three at least; equal: the entity's own store name, then the alphabet);
    fields without any known path are left out, for a person to fill in.
    """
    scores = []
    for name, entity in known.entities.items():
        wanted = {p for paths in entity.fields.values() for p in paths} | {p.split(".")[0] for paths in entity.fields.values() for p in paths}
        scores += [(len(own & wanted), store == entity.store, store, name) for store, own in fields.items() if len(own & wanted) >= 3]
    found: dict[str, dict] = {}
    used: set[str] = set()
    for _, _, store, name in sorted(scores, key=lambda s: (-s[0], not s[1], s[2], s[3])):
        if name not in found and store not in used:
            own = fields[store]
            mapped = {f: next(p for p in paths if p in own or p.split(".")[0] in own) for f, paths in known.entities[name].fields.items() if any(p in own or p.split(".")[0] in own for p in paths)}
            found[name] = {"store": store, "fields": mapped}
            used.add(store)
    return found
