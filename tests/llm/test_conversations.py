import random

from pyspark.sql import functions as F

from threadlake.llm import conversations as c

S = "row_no long, conv_id string, id string, version long, ts long, sender_mri string, is_system boolean, content string, root_id string"


def test_has_words(spark):
    blank = [None, "", " ", " ", "​", "<p>&nbsp;</p>", "<div>&#160;&#8203;</div>", "<br>", "&#xA0;&zwj;", '<img src="a.png">', "<!-- x > y -->", "﻿", "&#32;"]
    full = ["x", "&amp;nbsp;", "a < b", "&#65;", "&foo;", "<3", "👍", "&#1600;"]
    df = spark.createDataFrame([(t,) for t in blank + full], "t string")
    assert [r.v for r in df.select(c.has_words(F.col("t")).alias("v")).collect()] == [False] * len(blank) + [True] * len(full)


def by_hand(data):
    kept = {}
    for r in data:
        if r[1] is not None and (r[1:3] not in kept or ((r[3] or 0), r[0]) > ((kept[r[1:3]][3] or 0), kept[r[1:3]][0])):
            kept[r[1:3]] = r
    out = set()
    for conv in {k[0] for k in kept}:
        rows = [r for k, r in kept.items() if k[0] == conv]
        if any(r[8] is not None and r[8] not in {q[2] for q in rows} for r in rows):
            out.add((conv, "broken"))
        speaking = [r for r in rows if not r[6] and (r[7] or "").strip()]
        people = {r[5].strip().lower() for r in speaking if r[5] and r[5].strip().lower().startswith("8:")}
        if not speaking:
            out.add((conv, "empty"))
        elif len(people) < 2:
            out.add((conv, "no_reply"))
    return sorted(out)


def test_reasons_and_order(spark):
    r = random.Random(2)
    data = []
    for n in range(500):
        conv, i = r.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), str(r.randint(1, 12))
        data.append((n, conv, i, r.choice([None, 0, 1, 2]), r.choice([None, 0, r.randint(1, 10**10)]), r.choice([None, "?", "8:a", " 8:A", "8:b", "28:x"]), r.choice([None, True, False, False]), r.choice([None, "", " ", "hi", "<p>yo</p>"]), r.choice([i, i, i, None, str(r.randint(1, 12))])))
    df = spark.createDataFrame(data, S).withColumn("prefix", F.lit(1)).withColumn("person", F.lit(2))
    assert sorted(map(tuple, c.reasons(df).collect())) == by_hand(data)
    assert c.reasons(df.limit(0)).count() == 0
    bad = {x for x, _ in by_hand(data)}
    got = c.conversations(df).collect()
    assert not {x.conv_id for x in got} & bad
    for conv in {x.conv_id for x in got}:
        own = sorted((x for x in got if x.conv_id == conv), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own)))
    told = {r[0]: r for r in data}
    contents = {(r[1], r[2]): r[7] for r in sorted(told.values(), key=lambda r: ((r[3] or 0), r[0]))}
    assert all(x.content == contents[x.conv_id, x.id] for x in got)


def test_order_by_paths(spark):
    """Threads stay together; a reply that opens a thread of its own forks; roots that answer each other are no gap."""
    day = 86_400_000
    rows = [("1", "1", 10), ("2", "1", 20), ("3", "3", 15), ("4", "1", 3 * day), ("5", "1", 3 * day + 5), ("6", "3", 40), ("7", "2", 30), ("8", "9", 50), ("9", "8", 60), ("0", "0", 70)]
    data = [(n, "c", i, 1, ts, "8:a" if n % 2 else "8:b", False, i, root) for n, (i, root, ts) in enumerate(rows)]
    df = spark.createDataFrame(data, S)
    got = [x.id for x in sorted(c.conversations(df).collect(), key=lambda x: x.position)]
    assert got[:4] == ["1", "2", "3", "6"] and got.index("4") + 1 == got.index("5") and sorted(got) == sorted(i for i, _, _ in rows)
    assert c.reasons(df).count() == 0
    assert [tuple(x) for x in c.reasons(df.filter("id <> '3'")).collect()] == [("c", "broken")]


def test_circles_and_long_paths(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)] + [("x", "y"), ("y", "z"), ("z", "x"), ("p", "q"), ("q", "p"), ("s", "s")]
    got = {r.frag_id: (r.head, r.place) for r in c.merge_paths(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"n{i:03}": ("n000", i) for i in range(1, 151)} | {"y": ("x", 1), "z": ("x", 2), "q": ("p", 1)}
    parts = [("a", [1, 2]), ("b", [2, 3]), ("c", [3, 1])]
    out = {r.frag_id: (r.path_id, r.place) for r in c.assemble(spark.createDataFrame(parts, "frag_id string, hashes array<long>")).collect()}
    assert out == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2)}


def test_assemble(spark):
    line = list(range(100, 160))
    parts = [("a", line[:20]), ("b", line[15:40]), ("c", line[38:60]), ("copy", line[15:40]), ("alone", [1, 2, 3]), ("fork", [7, 8]), ("left", [8, 9]), ("right", [8, 10]), ("none", [])]
    out = {r.frag_id: (r.path_id, r.place, r.overlap) for r in c.assemble(spark.createDataFrame(parts, "frag_id string, hashes array<long>")).collect()}
    assert out["a"] == ("a", 0, 0) and out["b"] == ("a", 1, 5) and out["c"] == ("a", 2, 2)
    assert out["alone"][1:] == (0, 0) and {out[k][1] for k in ("fork", "left", "right")} == {0}
    assert "copy" not in out and "none" not in out


def test_assemble_long_overlaps_and_contained_fragments(spark):
    line = list(range(-1000, 2000))
    parts = [("a", line[:200]), ("b", line[100:300]), ("c", line[290:2000]), ("d", line[500:3000]), ("first", line[:50]), ("mid", line[120:180]), ("end", line[2990:]), ("one", line[150:151]), ("broken", line[400:440] + line[441:450])]
    out = {r.frag_id: (r.path_id, r.place, r.overlap) for r in c.assemble(spark.createDataFrame(parts, "frag_id string, hashes array<long>")).collect()}
    assert out == {"a": ("a", 0, 0), "b": ("a", 1, 100), "c": ("a", 2, 10), "d": ("a", 3, 1500), "broken": ("broken", 0, 0)}


def test_assemble_against_brute_force(spark):
    r = random.Random(7)
    for _ in range(3):
        parts = {f"f{i:02}": [r.choice([1, 2, 3, 4]) for _ in range(r.randint(1, 7))] for i in range(12)}
        once = {}
        for f, h in parts.items():
            once.setdefault(tuple(h), f)
        once = {f: h for h, f in once.items() if not any(len(o) > len(h) and h in {o[k : k + len(h)] for k in range(len(o))} for o in once)}
        ends = [(f, k, h[-k:], h[:k]) for f, h in once.items() for k in range(1, len(h))]
        met = [(k, s, d) for s, k, t, _ in ends for d, j, _, h in ends if t == h and s != d and sum(e[2] == t for e in ends) == 1 and sum(e[3] == h for e in ends) == 1]
        longest = [max(e for e in met if e[1] == s) for s in {e[1] for e in met}]
        want = {d: max(e for e in longest if e[2] == d)[0] for d in {e[2] for e in longest}}
        got = c.assemble(spark.createDataFrame(list(parts.items()), "frag_id string, hashes array<long>")).collect()
        assert {x.frag_id: x.overlap for x in got} == {f: want.get(f, 0) for f in once}
