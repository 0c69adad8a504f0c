"""Extracted records (strings by field) as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.text import conversation_kind, html_to_text


def epoch_ms(v: Column) -> Column:
    """Milliseconds of a number or an ISO time; 0 for anything else."""
    return F.coalesce(v.try_cast("double").cast("long"), F.unix_millis(v.try_cast("timestamp")), F.lit(0))


def true(v: Column) -> Column:
    return F.coalesce(F.lower(v) == "true", F.lit(False))


def truthy(v: Column) -> Column:
    return F.coalesce(~F.lower(v).isin("false", "0", ""), F.lit(False))


def _number(v: Column) -> Column:
    n = v.try_cast("decimal(38,0)")
    return F.coalesce(F.when(n.between(-(2**62), 2**62), n.cast("long")), F.lit(0))


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of repeated keys the row that came last: highest seq, then record."""
    w = W.partitionBy(key).orderBy(F.desc("seq"), F.desc("record_key"), F.desc("item_ord"))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def vote_self(records: DataFrame) -> str | None:
    """The sender of most rows that the owner sent; of equals the first by id. One row comes to the driver."""
    row = records.filter(true(F.col("sent_by_me")) & F.col("sender").isNotNull()).groupBy("sender").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sender").first()
    return row["sender"] if row else None


def mentioned(mentions: Column) -> Column:
    """Ids in a mentions value: a list, the JSON text of one, or an object that holds it."""
    inner = F.coalesce(F.get_json_object(mentions, "$.properties.mentions"), mentions)
    items = F.from_json(inner, "array<struct<mri:string,itemid:string,id:string>>")
    ids = F.transform(items, lambda x: F.coalesce(F.nullif(x["mri"], F.lit("")), F.nullif(x["itemid"], F.lit("")), F.nullif(x["id"], F.lit(""))))
    return F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def reactions(emotions: Column) -> Column:
    """Groups with users, users by MRI and groups by key; null if none."""
    groups = F.from_json(emotions, "array<struct<key:string,users:array<struct<mri:string,time:string>>>>")
    users = lambda g: F.array_sort(F.transform(F.filter(F.coalesce(g["users"], F.array().cast("array<struct<mri:string,time:string>>")), lambda u: F.coalesce(u["mri"], F.lit("")) != ""), lambda u: F.struct(u["mri"].alias("mri"), epoch_ms(u["time"]).alias("ts"))))
    shaped = F.filter(F.transform(groups, lambda g: F.struct(g["key"].alias("k"), users(g).alias("u"))), lambda g: (F.coalesce(g["k"], F.lit("")) != "") & (F.size(g["u"]) > 0))
    return F.when(F.size(shaped) > 0, F.array_sort(shaped))


def messages(records: DataFrame, me: str | None = None) -> DataFrame:
    """One row per (conv_id, id): the highest version, of equals the later row. Rows without a conversation are left out."""
    me = me or vote_self(records)
    mine = true(F.col("sent_by_me")) | (F.coalesce(F.col("sender") == F.lit(me), F.lit(False)) if me else F.lit(False))
    filled = lambda c: F.coalesce((F.length(c) > 2) & (F.col(c) != "[]"), F.lit(False))
    system = (F.coalesce(F.col("type"), F.lit("Message")) != "Message") | F.coalesce(F.col("message_type").rlike("(?i)^ThreadActivity/|Control|Event|SystemMessage"), F.lit(False))
    time = epoch_ms(F.col("time"))
    rows = records.filter("conv_id is not null").select(
        "conv_id", "id", F.col("record_key").alias("chain_key"), _number(F.col("version")).alias("version"),
        F.when(time != 0, time).otherwise(_number(F.col("id"))).alias("ts"), F.coalesce("sender", F.lit("?")).alias("sender_mri"), F.coalesce("sender_name", F.lit("")).alias("sender_name"),
        conversation_kind(F.col("conv_id")).alias("kind"), mine.alias("is_mine"), system.alias("is_system"),
        (F.coalesce(F.col("content").rlike(r"(?i)<img|itemid=|hostedContents|/v1/objects/"), F.lit(False)) | filled("files") | filled("cards") | filled("attachments")).alias("has_attach"),
        ((F.array_contains(mentioned(F.col("mentions")), me) & ~mine) if me else F.lit(False)).alias("mentions_me"),
        html_to_text(F.coalesce("content", F.lit(""))).alias("content"), reactions(F.col("reactions")).alias("reactions"),
        F.when(F.col("parent").isNotNull() & (F.col("parent") != F.col("id")), F.col("parent")).otherwise(F.col("id")).alias("root_id"), "seq", "item_ord",
    )
    w = W.partitionBy("conv_id", "id").orderBy(F.desc("version"), F.desc("seq"), F.desc("chain_key"), F.desc("item_ord"))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "seq", "item_ord")


def conversations(records: DataFrame) -> DataFrame:
    rows = _last(records.filter("id is not null"), "id")
    return rows.select("id", conversation_kind(F.col("id")).alias("kind"), "topic", "team_id", F.coalesce("thread_type", "type").alias("thread_type"), epoch_ms(F.col("last_time")).alias("meta_last_ts"))


def profiles(records: DataFrame) -> DataFrame:
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"\([^)]*\)", ""), r"\s+", " "))
    federated = (F.coalesce("type", F.lit("")) == "Federated") & (F.trim(F.coalesce("surname", F.lit(""))) == "")
    comma = F.instr(clean, ",")
    given = F.when(federated, F.when(comma > 0, F.trim(F.substr(clean, comma + 1))).otherwise(clean)).otherwise(F.coalesce("given_name", F.lit("")))
    surname = F.when(federated, F.when(comma > 0, F.trim(F.substr(clean, F.lit(1), comma - 1))).otherwise(F.lit(""))).otherwise(F.coalesce("surname", F.lit("")))
    rows = _last(records.filter("mri is not null and name is not null"), "mri")
    return rows.select("mri", "name", given.alias("given_name"), surname.alias("surname"), F.coalesce("type", F.lit("None")).alias("type"), F.coalesce("org", F.lit("")).alias("org"))


def events(records: DataFrame) -> DataFrame:
    """Series masters are left out; a missing id is the record's key; rooms are no attendees."""
    cid = F.when(F.contains("cid", F.lit("19:meeting_")), F.col("cid"))
    people = F.from_json("attendees", "array<struct<name:string,address:string,type:string,status:struct<response:string>>>")
    kept = F.filter(people, lambda a: (F.lower(F.coalesce(a["type"], F.lit(""))) != "resource") & ((F.coalesce(a["name"], F.lit("")) != "") | (F.coalesce(a["address"], F.lit("")) != "")))
    shaped = F.transform(kept, lambda a: F.struct(F.coalesce(a["name"], F.lit("")).alias("n"), F.coalesce(a["address"], F.lit("")).alias("e"), F.coalesce(a["status"]["response"], F.lit("")).alias("r")))
    rows = records.filter("coalesce(event_type, '') <> 'RecurringMaster'").withColumn("id", F.coalesce("id", "record_key"))
    return _last(rows, "id").select(
        "id", "series_id", F.when(cid.isNotNull() | true(F.col("online")), "meeting").otherwise("appointment").alias("kind"), "subject", epoch_ms(F.col("start")).alias("start_ts"), epoch_ms(F.col("end")).alias("end_ts"), true(F.col("all_day")).alias("is_all_day"), "location", "organizer_name", "organizer_email",
        cid.alias("cid"), "my_response", "show_as", true(F.col("cancelled")).alias("is_cancelled"), (truthy(F.col("label")) | true(F.col("no_forward"))).alias("is_confidential"), true(F.col("has_attach")).alias("has_attach"), F.when(F.size(shaped) > 0, F.array_sort(shaped)).alias("attendees"), "body_html",
    )


def calls(records: DataFrame) -> DataFrame:
    people = F.from_json("participants", "array<struct<id:string,displayName:string>>")
    shaped = F.transform(F.filter(people, lambda p: F.coalesce(p["id"], F.lit("")) != ""), lambda p: F.struct(p["id"].alias("mri"), p["displayName"].alias("name")))
    link = lambda f: F.coalesce(F.get_json_object("recordings", f"$[0].linkedMessage.{f}"), F.get_json_object("transcript", f"$.linkedMessage.{f}"))
    rows = records.withColumn("id", F.coalesce("id", "record_key"))
    return _last(rows, "id").select(
        "id", "call_type", "direction", "state", F.coalesce(F.col("state") == "Missed", F.lit(False)).alias("is_missed"), epoch_ms(F.col("start")).alias("start_ts"), _number(F.col("duration")).alias("duration_ms"),
        F.when(F.col("direction") == "Outgoing", F.col("target")).otherwise(F.col("originator")).alias("counterpart_mri"), F.when((F.col("call_type") == "MultiParty") & (F.size(shaped) > 0), F.array_sort(shaped)).alias("participants"), "group_thread_id",
        F.coalesce(F.col("recordings").startswith("[") & (F.col("recordings") != "[]"), F.lit(False)).alias("has_recording"), F.when(link("conversationId").isNotNull() & link("linkedMessageId").isNotNull(), F.struct(link("conversationId").alias("conversation_id"), link("linkedMessageId").alias("linked_message_id"))).alias("recording_link"),
        truthy(F.col("voicemail")).alias("has_voicemail"), "spam_level", (F.coalesce(F.lower("user_part"), F.lit("")) != "false").alias("is_current_user_part"), true(F.col("deleted")).alias("is_deleted"),
    )
