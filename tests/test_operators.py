import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from threadlake.session import cut
from threadlake.operators import changefeed, drift, fold, intervals, ledger, ordering, sessions, snapshot

BIG = 2**62


# Sessions


def sessions_by_hand(events, gap):
    out, by = [], {}
    for who, ts, conv in events:
        if who is not None and ts is not None:
            by.setdefault(who, []).append((ts, conv))
    for who, found in by.items():
        found.sort(key=lambda x: x[0])
        part = [found[0]]
        for e in found[1:]:
            if e[0] - part[-1][0] > gap:
                out.append((who, part[0][0], part[-1][0], len(part), len({c for _, c in part if c is not None})))
                part = []
            part.append(e)
        out.append((who, part[0][0], part[-1][0], len(part), len({c for _, c in part if c is not None})))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions(spark, seed):
    r = random.Random(seed)
    events = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(0, 400)]), r.choice(["x", "y", None])) for _ in range(400)]
    events += [("edge", t, "x") for t in (0, 10, 10, 21, 31, 31)] * 2
    df = spark.createDataFrame(events, "who string, ts long, conv string").withColumn("cell", F.lit("clash")).withColumn("entity", F.lit(1))
    assert rows(sessions.sessions(df, "who", "ts", 10, distinct="conv")) == sessions_by_hand(events, 10)
    assert rows(sessions.sessions(df, "who", "ts", 10)) == sorted((x[:4] for x in sessions_by_hand(events, 10)), key=repr)


def test_sessions_of_nothing(spark):
    assert rows(sessions.sessions(spark.createDataFrame([], "who string, ts long, conv string"), "who", "ts", 10, distinct="conv")) == []


# Intervals


def periods_by_hand(found):
    out = []
    for who in {w for w, _, _ in found if w is not None}:
        own = sorted((s, e) for w, s, e in found if w == who and s is not None and e is not None and e > s)
        merged = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(who, "period", s, e) for s, e in merged]
        out += [(who, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [7, 50, 86_400_000])
def test_periods(spark, cell):
    r = random.Random(cell)
    found = []
    for _ in range(300):
        s = r.randint(0, 900)
        found.append((r.choice(["a", "b", None]), r.choice([s, s, s, None]), r.choice([s + r.randint(-2, 12), s + r.randint(0, 120), None])))
    found += [("touch", 0, 5), ("touch", 5, 9), ("touch", 10, 11), ("far", BIG, BIG + 5), ("far", BIG + 5, BIG + 9), ("far", 3, 4), ("neg", -20, -10), ("neg", -10, 3)]
    df = spark.createDataFrame(found, "who string, s long, e long").withColumn("finish", F.lit(None)).withColumn("cell", F.lit(0))
    assert rows(intervals.periods_and_gaps(df, "who", "s", "e", cell)) == periods_by_hand(found)


def test_periods_of_nothing(spark):
    assert rows(intervals.periods_and_gaps(spark.createDataFrame([], "who string, s long, e long"), "who", "s", "e")) == []


# Change feeds


def fold_by_hand(feed):
    state = {}
    for cache, seq, op, key, version in sorted({f for f in feed if None not in f[:4]}, key=lambda f: (f[0], f[1])):
        held = state.get((cache, key))
        v = int(version) if version and version.lstrip("-").isdigit() else 0
        if op == 0:
            state.pop((cache, key), None)
        elif op == 1 and (held is None or v >= held[1]):
            state[cache, key] = (seq, v)
    return sorted(((c, k, s) for (c, k), (s, _) in state.items()), key=repr)


FEED = "cache_id long, seq long, op_type int, entry_key string, version string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_live_records(spark, seed):
    r = random.Random(seed)
    feed = [(r.choice([1, 2]), i, r.choice([0, 1, 1, 1, 7]), r.choice("abcde"), r.choice([None, "x", "1", "2", "10", "99999999999999999999"])) for i in range(120)]
    feed += r.sample(feed, 40) + [(None, 1, 1, "a", "1"), (1, None, 1, "a", "1"), (1, 5000, 1, None, "1"), (1, 5001, None, "a", "1")]
    r.shuffle(feed)
    df = spark.createDataFrame(feed, FEED).withColumn("_rank", F.lit(0))
    assert rows(changefeed.live_records(df).select("cache_id", "entry_key", "seq")) == fold_by_hand(feed)
    # In parts of any order, the last one twice: the same table.
    columns = [c for c in df.columns if c != "_rank"]
    parts = [spark.createDataFrame(feed[i::3], FEED) for i in range(3)]
    state = changefeed.state(parts[2])
    for part in (parts[0], parts[1], parts[1]):
        state = cut(changefeed.merge(state, part))
        assert set(state.columns) == set(columns)
    assert rows(changefeed.live_records(state).select("cache_id", "entry_key", "seq")) == fold_by_hand(feed)


def test_late_changes(spark):
    def table(*parts):
        state = changefeed.state(spark.createDataFrame(parts[0], FEED))
        for part in parts[1:]:
            state = cut(changefeed.merge(state, spark.createDataFrame(part, FEED)))
        return [x[2] for x in rows(changefeed.live_records(state).select("cache_id", "entry_key", "seq"))]

    assert table([(1, 5, 1, "k", "1"), (1, 9, 0, "k", None)], [(1, 7, 1, "k", "5")]) == []
    assert table([(1, 5, 1, "k", "10"), (1, 9, 1, "k", "3")], [(1, 7, 0, "k", None)]) == [9]
    assert table([(1, 5, 1, "k", "10"), (1, 9, 1, "k", "3")]) == [5]
    assert table([(1, 5, 1, "k", "1"), (1, 5, 1, "k", "2"), (1, 5, 0, "k", None)]) == []


def test_feed_of_nothing(spark):
    assert rows(changefeed.live_records(spark.createDataFrame([], FEED))) == []


# The ledger


def test_runs_and_subtract(spark):
    r = random.Random(4)
    have = {(k, n) for k in "ab" for n in r.sample(range(65_400, 65_700), 150)}
    df = spark.createDataFrame(sorted(have), "k string, seq long")
    found = ledger.runs(df, ["k"])
    assert {(x.k, n) for x in found.collect() for n in range(x.lo, x.hi + 1)} == have
    assert found.count() == sum((k, n - 1) not in have for k, n in have)
    done = spark.createDataFrame([("a", -(2**62), 65_450), ("a", 65_500, 65_550), ("a", 65_560, 65_600), ("c", 0, 9)], "k string, lo long, hi long")
    left = {(k, n) for k, n in have if not (k == "a" and (n <= 65_450 or 65_500 <= n <= 65_550 or 65_560 <= n <= 65_600))}
    assert {tuple(x) for x in ledger.subtract(df, done, ["k"]).select("k", "seq").collect()} == left
    clash = df.withColumn("lo", F.lit(1)).withColumn("hi", F.lit(2))
    assert ledger.subtract(clash, done, ["k"]).count() == len(left)
    assert ledger.subtract(df, done.limit(0), ["k"]).count() == len(have)
    assert ledger.subtract(df.limit(0), done, ["k"]).count() == 0


def test_intervals_far_and_wide(spark):
    wide = [("a", 0, 2**40), ("a", 2**40 + 1, 2**41), ("a", 2**41 + 2, 2**41 + 5), ("a", 5, 7), (None, 1, 2), (None, 3, 3), ("b", -5, -5)] + [("s", 2 * i, 2 * i) for i in range(300)] + [("t", 70_000 * i, 70_000 * i + 5) for i in range(200)] + [("t", 3, 69_999)]
    merged = ledger.merge_intervals(spark.createDataFrame(wide, "k string, lo long, hi long").withColumn("reached", F.lit(1)), ["k"])
    want = [("a", 0, 2**41), ("a", 2**41 + 2, 2**41 + 5), (None, 1, 3), ("b", -5, -5)] + [("s", 2 * i, 2 * i) for i in range(300)] + [("t", 0, 70_005)] + [("t", 70_000 * i, 70_000 * i + 5) for i in range(2, 200)]
    assert rows(merged) == sorted(want, key=repr)
    seen = [("a", 2**40 + 9), ("a", 2**41 + 1), ("a", 2**41 + 5), ("a", -1), ("a", 2**41 + 6), (None, 3), (None, 4), ("t", 140_005), ("t", 140_006), ("z", 1), ("a", None)]
    left = ledger.subtract(spark.createDataFrame(seen, "k string, seq long"), merged, ["k"])
    assert rows(left) == sorted([("a", 2**41 + 1), ("a", -1), ("a", 2**41 + 6), (None, 4), ("t", 140_006), ("z", 1)], key=repr)


def test_ledger_survives_failure_and_late_commits(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path), ["k"])
    table = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 5, "z")], "k string, seq long, v string")
    book.run(table, lambda df: df)

    def broken(df):
        raise RuntimeError("lost")

    more = table.unionByName(spark.createDataFrame([("a", 3, "late"), ("b", 1, "new")], table.schema))
    with pytest.raises(RuntimeError):
        book.run(more, broken)
    book.run(more, lambda df: df)
    book.run(more, lambda df: df)
    assert rows(book.output().select("k", "seq")) == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1)]
    with pytest.raises(FileExistsError):
        book.commits.commit(0, {})
    assert rows(book.intervals()) == [("a", 1, 3), ("a", 5, 5), ("b", 1, 1)]


def test_pending_entries(spark):
    states = spark.createDataFrame(
        [(1, 7, "2025-01-01", "inplace", 10, {"profile": "3:1:5:9, 8:1:2:1,bad,9:9:x:1", "call": ""}), (2, 7, "2025-01-02", "error", 99, {}), (3, 7, None, "swapped", 99, {}), (4, 8, "2025-01-01", "swapped", None, None)],
        "run_id long, cache_id long, finished_at string, outcome string, max_seq long, store_sigs map<string,string>",
    )
    e = [(7, 4, "profile", 3, 1), (7, 6, "profile", 3, 1), (7, 6, "profile", 3, 1), (7, 1, "profile", 8, 1), (7, 3, "call", 5, 1), (7, 10, "message", 2, 1), (7, 11, None, 2, 1), (8, 1, "message", 2, 1), (9, 1, "event", 4, 1), (None, 1, "event", 4, 1)]
    df = spark.createDataFrame(e, "cache_id long, seq long, entity string, db_id int, os_id int")
    assert rows(ledger.pending_entries(df, states)) == [(7, 11), (7, 3), (7, 6), (8, 1), (9, 1)]
    assert ledger.pending_entries(df.limit(0), states).count() == 0
    assert ledger.pending_entries(df, states.limit(0)).count() == 8


# Drift

RAW = "raw_id long, cache_id long, file_no int, store string, rec_key string, payload string"


def test_changes(spark):
    old = ['{"id":1,"a":{"b":"x","c":1},"t":5,"gone":true,"n":null}', '{"id":2,"a":{"b":"y","c":2},"t":6}', '{"id":3,"a":{"b":null}}']
    new = ['{"id":1,"a":{"bb":"x","c":1},"t":"5","n":[1]}', '{"a":{"bb":"y","c":2},"id":2,"t":"6","Id":1}', '{"id":3}']
    raw = [(i, 1, 1, "s", f"k{i}", p) for i, p in enumerate(old)] + [(10 + i, 1, 4, "s", f"k{i}", p) for i, p in enumerate(new)]
    raw += [raw[0], (90, 1, 2, "other", "k", "{}"), (91, 1, 3, "s2", "k", "no json"), (92, 1, 4, "s2", "k", None), (93, None, 4, "s", "k", '{"q":1}'), (94, 1, 4, "s", None, '{"id":4}')]
    df = spark.createDataFrame(raw, RAW).withColumn("path", F.lit("clash"))
    assert rows(drift.changes(df)) == sorted([(1, 4, "s", "renamed", "a.b", "a.bb"), (1, 4, "s", "type_changed", "t", ""), (1, 4, "s", "removed", "gone", ""), (1, 4, "s", "added", "Id", "")], key=repr)
    assert drift.changes(df.limit(0)).count() == 0


def test_rescue_promote_replay(spark):
    raw = spark.createDataFrame([(1, 1, 1, "s", "k1", '{"a":"x","n":"12","extra":{"z":[1,2]},"raw_id":9}'), (2, 1, 1, "s", "k2", '{"a":5,"n":"many"}'), (3, 1, 1, "s", "k3", "broken"), (4, 1, 1, "s", "k4", None)], RAW)
    t = drift.ingest(raw, {"a": "string", "raw_id": "long"})
    assert [(r.a, r._rescued) for r in t.orderBy("raw_id").collect()] == [("x", '{"extra.z": [1, 2], "n": "12", "raw_id": 9}'), (None, '{"a": 5, "n": "many"}'), (None, '{"": "broken"}'), (None, None)]
    p = drift.promote(t, {"n": "long", "extra.z": "array"})
    got = [(r.n, r["extra.z"], r._rescued) for r in p.orderBy("raw_id").collect()]
    assert got == [(12, "[1, 2]", '{"raw_id": 9}'), (None, None, '{"a": 5, "n": "many"}'), (None, None, '{"": "broken"}'), (None, None, None)]


# Folds, positions and snapshots


def test_kept_messages(spark):
    m = [(1, "c", "1", 5), (2, "c", "1", None), (3, "c", "1", 5), (4, None, "1", 9), (5, "c", "2", None), (6, "c", "2", 0), (7, "c", None, 1)]
    df = spark.createDataFrame(m, "row_no long, conv_id string, id string, version long").withColumn("_rank", F.lit(1))
    assert sorted(r.row_no for r in fold.kept_messages(df).collect()) == [3, 6, 7]


def test_ordinals(spark):
    r = random.Random(3)
    m = [(r.choice("ab"), r.randint(-50, 500), i) for i in range(200)]
    df = spark.createDataFrame(m, "k string, ts long, id long").withColumn("_cell", F.lit(1))
    want = {}
    for k in "ab":
        for n, (_, i) in enumerate(sorted((t, i) for kk, t, i in m if kk == k)):
            want[i] = n
    assert {x.id: x.position for x in ordering.ordinals(df, ["k"], "ts", ["id"], cell=37).collect()} == want


def test_snapshot_order_does_not_matter(spark):
    e = [(i, 1, "%06d.%s" % (i % 3, "log" if i % 2 else "ldb"), i, i // 4, i % 2, "k%d" % (i % 5)) for i in range(60)]
    s = "entry_id long, cache_id long, file string, entry_ord long, seq long, op_type int, entry_key string"
    a = spark.createDataFrame(e, s)
    b = spark.createDataFrame(random.Random(1).sample(e, len(e)), s)
    assert rows(snapshot.winners(a)) == rows(snapshot.winners(b))
    assert max(r.seq for r in snapshot.winners(a, cap=7).collect()) <= 7


def test_store_table(spark):
    raw = spark.createDataFrame([(1, 1, 1, "s", "k", '{"a":"x","b":{"c":1}}'), (2, 1, 1, "s", "k", '{"a":"y","b":{"c":2}}'), (3, 1, 2, "s", "k", '{"a":5,"rare":1}'), (4, 1, 3, "s", "k", '{"a":"z"}'), (5, 1, 1, "t", "k", '{"q":1}')], RAW)
    assert drift.majority_schema(raw, "s") == {"a": "string"}
    assert rows(drift.store_table(raw, "s").select("raw_id", "a", "_rescued")) == [(2, "y", '{"b.c": 2}'), (3, None, '{"a": 5, "rare": 1}'), (4, "z", None)]
    assert drift.store_table(raw.limit(0), "s").count() == 0


def test_renames_of_equal_values(spark):
    old, new = '{"a": true, "b": true, "z": 1}', '{"c": true, "d": true, "z": 1}'
    raw = spark.createDataFrame([(i, 1, f, "s", f"k{i % 2}", p) for i, (f, p) in enumerate([(1, old), (1, old), (2, new), (2, new)])], "raw_id long, cache_id long, file_no int, store string, rec_key string, payload string")
    assert rows(drift.changes(raw)) == [(1, 2, "s", "renamed", "a", "c"), (1, 2, "s", "renamed", "b", "d")]


def changes_by_hand(raw):
    """The definition, record by record."""
    files = {}
    for raw_id, cache, file_no, store, key, payload in sorted(raw, key=lambda r: r[0]):
        if None not in (cache, file_no, store):
            files.setdefault((cache, store), {}).setdefault(file_no, []).append((key, dict(drift.leaves(drift.parse(payload) or {}))))
    out = []
    for (cache, store), by_file in files.items():
        for old_no, new_no in zip(sorted(by_file), sorted(by_file)[1:]):
            old, new = by_file[old_no], by_file[new_no]
            types = lambda rows, p: {drift.json_type(r[p]) for _, r in rows if r.get(p) is not None}
            was, now = {p for _, r in old for p in r}, {p for _, r in new for p in r}
            a, b = {k: r for k, r in old if k is not None}, {k: r for k, r in new if k is not None}
            both = a.keys() & b.keys()
            pairs = []
            for g in was - now:
                for c in now - was:
                    if all(a[k].get(g) == b[k].get(c) and type(a[k].get(g)) is type(b[k].get(c)) for k in both):
                        n = sum(a[k].get(g) is not None for k in both)
                        pairs += [(-n, g, c)] * (n >= 2)
            gone, come = was - now, now - was
            for _, g, c in sorted(pairs):
                if g in gone and c in come:
                    out.append((cache, new_no, store, "renamed", g, c))
                    gone.remove(g), come.remove(c)
            out += [(cache, new_no, store, "removed", p, "") for p in gone] + [(cache, new_no, store, "added", p, "") for p in come]
            out += [(cache, new_no, store, "type_changed", p, "") for p in was & now if types(old, p) and types(new, p) and types(old, p) != types(new, p)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_the_definition(spark, seed):
    import json

    r = random.Random(seed)
    raw, n = [], 0
    for cache in (1, 2):
        for store in ("s", "t"):
            for file_no in r.sample(range(1, 30), 8):
                fields = r.sample(["a", "b", "c", "d.x", "d.y", "e"], 4)
                for k in range(r.randint(1, 5)):
                    n += 1
                    record = {}
                    for f in fields:
                        if r.random() < 0.85:
                            v = r.choice([k, k, k, str(k), True, None, [k]])
                            if "." in f:
                                record.setdefault("d", {})[f[2]] = v
                            else:
                                record[f] = v
                    raw.append((n, cache, file_no, store, r.choice([f"k{k}", f"k{k}", None]), r.choice([json.dumps(record)] * 9 + ["no json"])))
    raw += [(n + 1, None, 1, "s", "k", "{}"), (n + 2, 1, 50, "s", "k", None)]
    df = spark.createDataFrame(r.sample(raw, len(raw)), RAW)
    assert rows(drift.changes(df)) == changes_by_hand(raw)
