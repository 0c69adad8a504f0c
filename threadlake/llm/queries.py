"""Queries of the problems on text (p1, p3, p8, p9, p10), with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import conversations, leaks, residue, tokens
from threadlake.llm.pii import operator as pii
from threadlake.llm.sql import SQL as SQL
from threadlake.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return conversations.reasons(table(spark, root, "messages"))


def p3_conversations(spark: SparkSession, root: str) -> DataFrame:
    return conversations.conversations(table(spark, root, "messages"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents"))


def p8_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose decoded ids differ from their text: none."""
    docs = table(spark, root, "documents")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").filter(F.coalesce("text", F.lit("")) != F.col("decoded")).select("doc_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_reparameterised(spark: SparkSession, root: str) -> DataFrame:
    return leaks.reparameterised(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.excluded(table(spark, root, "documents"))


def p10_evidence(spark: SparkSession, root: str) -> DataFrame:
    return residue.residual_evidence(table(spark, root, "documents"))


QUERIES = {
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_found": p9_found,
    "p9_reparameterised": p9_reparameterised,
    "p10_found": p10_found,
    "p10_evidence": p10_evidence,
}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    said = pii.find(table(spark, root, "messages"), [("content", pii.ALL), ("sender_name", pii.DISPLAY)])
    met = pii.find(table(spark, root, "calendar_events"), [("attendees", pii.ALL)])
    return said.unionByName(met)


def p1_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The messages with typed placeholders in the place of personal information."""
    rows = table(spark, root, "messages").select("row_no", "content", "sender_name")
    return pii.redact(rows, [("content", pii.ALL), ("sender_name", pii.DISPLAY)])


def p1_attendees_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The attendees of all calendar events with typed placeholders in the place of personal information (members n and r)."""
    return pii.redact(table(spark, root, "calendar_events").select("row_no", "attendees"), [("attendees", pii.ALL)])


def p1_left(spark: SparkSession, root: str) -> DataFrame:
    """What is still found after redaction, in messages and attendees: nothing."""
    said = pii.find(p1_redacted(spark, root), [("content", pii.ALL), ("sender_name", pii.DISPLAY)])
    return said.unionByName(pii.find(p1_attendees_redacted(spark, root), [("attendees", pii.ALL)]))


QUERIES = {"p1_found": p1_found, "p1_left": p1_left, "p1_redacted": p1_redacted, "p1_attendees_redacted": p1_attendees_redacted} | QUERIES
