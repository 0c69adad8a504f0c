import os

import pytest
from oracle import SMALL, connection, same

from threadlake.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


# Queries that SQL can't express, against plain Python over the same tables.


def read(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def latest_events():
    found = {}
    for e in sorted((e for e in read("calendar_events") if e["id"] is not None), key=lambda e: e["row_no"]):
        found[e["id"]] = e
    return found


def run(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def test_all_queries_are_tested():
    checked = {"html_to_text", "event_bodies", "glyphs", "hysteresis_rank", "fts_search", "fts_bm25_porter"} | {n for n in QUERIES if n.startswith("p2_table_")}
    assert set(QUERIES) - set(SQL) == checked


def test_html_and_bodies(spark):
    import re

    from threadlake.functions.text import plain_text

    events = latest_events()
    assert {r.id: r.text for r in run(spark, "html_to_text")} == {i: plain_text(e["body_html"]) for i, e in events.items() if e["body_html"] is not None}
    want = {}
    for i, e in events.items():
        if e["body_html"] is not None and not e["is_confidential"]:
            text = re.sub(r"(?i)https?://([^\s/<>\"]+)(/[^\s<>\"]*)?", r"[link: \1]", plain_text(e["body_html"]))
            text = re.sub(r"\s+", " ", text).strip()
            want[i] = text if len(text) <= 1000 else text[:1000] + "…"
    assert {r.id: r.body for r in run(spark, "event_bodies")} == want


def test_glyphs(spark):
    keys = {g["k"] for m in read("messages") if m["conv_id"] for g in m["reactions"] or [] if g["k"]}
    got = {r.key: r.glyph for r in run(spark, "glyphs")}
    assert set(got) <= keys and got and all(len(v) <= 8 for k, v in got.items() if k[:2] == "1f") and not any(v.startswith("1f") for v in got.values())


def test_hysteresis(spark):
    from threadlake.plans import analytics

    frames = {}
    for r in analytics.top_per_frame(spark, SMALL).join(analytics.rolling(spark, SMALL), ["day", "sender"]).collect():
        frames.setdefault(r.day, {})[r.sender] = float(r.sum_35d)
    order, want = [], set()
    for day in sorted(frames):
        value = frames[day]
        order = [k for k in order if k in value]
        order += sorted(set(value) - set(order), key=lambda k: (-value[k], k))
        moved = True
        while moved:
            moved = False
            for i in range(1, len(order)):
                if value[order[i]] > value[order[i - 1]] * 1.15:
                    order[i - 1 : i + 1] = [order[i], order[i - 1]]
                    moved = True
        want |= {(day, i + 1, k) for i, k in enumerate(order)}
    assert {tuple(r) for r in run(spark, "hysteresis_rank")} == want


def test_search(spark, con):
    want = con.sql(SQL["fts_bm25"]).fetchall()
    best = sorted(((round(s, 5), c, i) for c, i, s in want), key=lambda x: (-x[0], x[1], x[2]))[:20]
    got = run(spark, "fts_search")
    assert sorted(round(r.score, 5) for r in got) == sorted(s for s, _, _ in best)
    assert all("[" in r.snippet for r in got)


def test_stemmed_search(spark):
    import math
    import re
    from collections import Counter

    from threadlake.functions.porter import fold, porter
    from threadlake.plans.search import indexed

    docs = [(r.conv_id, r.id, [porter(fold(t)) for t in re.findall(r"[^\W_]+", r.text.lower())]) for r in indexed(spark, SMALL).collect()]
    terms = {porter(fold(t)) for t in ("measured", "snapshots")}
    df = Counter(t for _, _, ts in docs for t in terms & set(ts))
    mean = sum(len(ts) for _, _, ts in docs) / len(docs)
    want = {}
    for c, i, ts in docs:
        if terms <= set(ts):
            tf = Counter(ts)
            want[c, i] = round(sum(max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t in terms), 4)
    assert {(r.conv_id, r.id): round(r.score, 4) for r in run(spark, "fts_bm25_porter")} == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("p2_table_")))
def test_tables_lose_nothing(spark, name):
    """Typed columns and rescued values together are the fields of the record's payload."""
    import json

    from threadlake.operators.drift import RESCUED, leaves, parse

    payloads = {r["raw_id"]: r["payload"] for r in read("raw_records")}
    got = run(spark, name)
    assert got
    for row in got:
        r = row.asDict()
        rest = json.loads(r.pop(RESCUED) or "{}")
        typed = {k: v for k, v in r.items() if k not in ("raw_id", "cache_id", "file_no", "store", "rec_key") and v is not None}
        given = {p: v for p, v in leaves(parse(payloads[row.raw_id]) or {}) if v is not None}
        assert set(typed) | {p for p, v in rest.items() if v is not None} == set(given) and not set(typed) & set(rest)
        assert all((json.loads(v) if isinstance(given[p], list) else v) == given[p] or str(given[p]) in (str(v), str(v).lower()) or float(given[p]) == v for p, v in typed.items())
