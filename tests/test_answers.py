import os

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from threadlake.plans import analytics, answers, chat, silver

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_selectors_and_notes(spark):
    top = silver.people(spark, SMALL).filter("name <> ''").orderBy(F.desc("msg_count")).first()
    part = top.name[:2]
    assert answers.people_of(spark, SMALL, top.handle).first().mri == top.mri
    note = answers.ambiguity(spark, SMALL, part)
    n = answers.conversations_of(spark, SMALL, part).count()
    assert n < 2 or f"names {n} conversations" in note and note.count(";") == min(n, 4) - 1
    assert answers.ambiguity(spark, SMALL, "c:000000") == ""
    found = answers.search(spark, SMALL, conversation=part, limit=3)
    assert found.rows.count() <= 3 and found.notes == ((note,) if note else ())
    assert answers.search(spark, SMALL, exclude=["  ", "p:nobody"]).miss == "no-such-excluded-person"


def test_pages_join_to_the_whole(spark):
    conv = chat.largest_conversation(spark, SMALL)
    whole = [r.id for r in silver.messages(spark, SMALL).filter((F.col("conv_id") == conv) & ~F.col("is_system")).orderBy("ts", "id").collect()]
    got, cursor, pages = [], None, 0
    while pages < 3:
        page = answers.page(spark, SMALL, conv, cursor, limit=7)
        got = [r.id for r in page.rows.collect()] + got
        cursor, pages = page.older, pages + 1
        if not cursor:
            break
    assert got == whole[-len(got) :] and len(got) == min(21, len(whole))
    assert answers.page(spark, SMALL, "nowhere").older is None


def test_thread_windows(spark):
    top = chat.threads(spark, SMALL).orderBy(F.desc("n"), "conv_id", "root_id").first()
    replies = [r.id for r in chat.thread(spark, SMALL, top.conv_id, top.root_id).filter(F.col("id") != top.root_id).orderBy("ts", "id").collect()]
    last = answers.thread_window(spark, SMALL, top.conv_id, top.root_id, inline=2, size=2)
    assert [r.id for r in last.rows.orderBy("place").collect()][-2:] == replies[-2:] and last.total == top.n and (last.older == replies[-2]) == (len(replies) > 2)
    before = answers.thread_window(spark, SMALL, top.conv_id, top.root_id, before=last.older, inline=2, size=2)
    assert [r.id for r in before.rows.filter("place >= 0").orderBy("place").collect()] == replies[:-2][-2:]
    assert [r.place for r in answers.thread_window(spark, SMALL, top.conv_id, top.root_id).rows.filter("place >= 0").orderBy("place").collect()] == list(range(len(replies)))
    assert answers.thread_window(spark, SMALL, "x", "y").miss == "no-such-message"


def test_events_and_bodies(spark):
    last = answers.max_event_start(spark, SMALL).first().max_start
    ahead = answers.events(spark, SMALL, now=last - 3 * answers.DAY)
    assert ahead.rows.filter((F.col("start_ts") < last - 3 * answers.DAY) | (F.col("start_ts") > last + 4 * answers.DAY)).count() == 0 and "last stored occurrence" in ahead.notes[0]
    assert "single event" in answers.events(spark, SMALL, now=0, since=0, until=last, body=True).notes[-1]
    shown = answers.event_bodies(silver.events(spark, SMALL)).count()
    hidden = silver.events(spark, SMALL).filter("body_html is not null and is_confidential").count()
    assert shown + hidden == silver.events(spark, SMALL).filter("body_html is not null").count()


def test_ticks():
    assert analytics.ticks(0.5) == [0] and analytics.ticks(1200) == [0, 100, 250, 500, 1000]
