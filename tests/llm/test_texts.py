import random

import pytest

from threadlake.llm import leaks, residue, tokens

TEXTS = [None, "", " ", "Hello world", "<|endoftext|> is text", "naïve 👩‍👩‍👧‍👦 ｆｕｌｌ", "\x00\x01 ", "ab " * 40_000, "x" * 50_000, "日本語のテキスト", "﻿BOM"]


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    coded = tokens.encode(df)
    ids = {r.doc_id: r.ids for r in coded.collect()}
    assert ids[0] == [] and ids[1] == [] and 50256 not in ids[4]
    assert {r.doc_id: r.text for r in tokens.decode(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0


def test_offsets_and_split_characters(spark):
    text = "a 👍 é"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = tokens.encode(df, offsets=True).first()
    assert len(r.ids) == len(r.starts) == len(r.ends) and r.ends[-1] == len(text)
    assert any(tokens.decode_ids([i]) == "�" for i in r.ids) and tokens.decode_ids(r.ids) == text
    assert len(tokens.byte_characters()) == len(set(tokens.byte_characters().values())) == 256


def test_against_the_other_library():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = tokens._tokenizer(tokens.vocabulary())
    for t in TEXTS[1:7] + TEXTS[9:]:
        assert mine.encode(t, add_special_tokens=False).ids == other.encode_ordinary(t)


PASSAGE = "Neither Ashkovane nor Berzanova could explain why the spindle at Ostfield weighed 175 stones more than the Stonestedt sextant from June."


def test_leaks(spark):
    w = PASSAGE.split()
    upper = " ".join(w[3:16]).upper()
    marked = " ".join(f"<b>{x}</b>&nbsp;" if i % 3 else f"_{x}_ **,**" for i, x in enumerate(w[2:15]))
    broken = " ".join(w[:12]).replace("explain", "ex­pla​in").replace("spindle", "spin-\ndle")
    docs = {1: upper, 2: marked, 3: broken, 4: " ".join(w[:11]), 5: PASSAGE.replace("175", "176").replace("Ashkovane", "Brenkovane"), 6: "> " + "\n> ".join(w), 7: None, 8: "", 9: "word " * 50_000 + PASSAGE, 10: " ".join(w[:6] + ["maybe"] + w[6:12]), 11: "Ｎeither Ashkovane nor Berzanova could explain why the spindle at Ostﬁeld weighed"}
    d = spark.createDataFrame([(k, v, "c") for k, v in docs.items()] + [(1, upper, "c")], "doc_id long, text string, window string")
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short"), (3, None), (4, PASSAGE)], "item_id long, passage string")
    want = sorted((k, i) for k in (1, 2, 3, 6, 9, 11) for i in (1, 4))
    assert sorted(map(tuple, leaks.leaks(d, items).collect())) == want
    assert sorted(map(tuple, leaks.leaks(d, items, bound=0).collect())) == want  # the shuffled way
    assert [tuple(x)[:3] for x in leaks.reparameterised(d, items).collect()] == [(5, 1, 2)]
    assert leaks.leaks(d.limit(0), items).count() == 0 and leaks.leaks(d, items.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)] + ["7", "8", "Anna"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(8)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(60)] + [(100 + i, "a " + " ".join(p.split()[i : i + 13]) + " b") for i, p in items]

    def grams(t, n):
        w = leaks.words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    for n in (4, 12):
        want = sorted((d, i) for d, t in docs for i, p in items if grams(t, n) & grams(p, n))
        got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), size=n)
        assert sorted(map(tuple, got.collect())) == want


BAD = ["Hi {{first_name}}, your meeting starts at 10.", "Owner: [Organizer]", "Dear %s,", "Due: XX.XX.XXXX", "Channel: &lt;start time&gt;", "Room: (TBD: room)", "Welcome to $CHANNEL$!", "lorem ipsum dolor sit amet consectetur adipiscing elit", "asdf foo bar asdf test test", "Click to add text. Click to add text.", "404 Not Found", "HTTP Status 500 – Internal Server Error", "<html><head><title>Help</title></head><body><h1>[object Object]</h1></body></html>", "Die angeforderte Nachricht existiert nicht mehr. (Fehler 9212)", "Please enable JavaScript to view this conversation.", "Veuillez activer JavaScript pour continuer.", '{"error": {"code": "TooManyRequests"}}', "Heading 1\nBullet 2", "KeyError: 'content'", "Dies ist ein Blindtext, der nur den Platz füllt. Hier könnte Ihr Text stehen."]
GOOD = [None, "", "  ", "Rafael got a 404 Not Found on the calendar tab for 56 minutes, it is fixed since 11:42.", "We wrote a test for the KeyError in render.py, line 33; it passes now.", "In the mail template, `{{first_name}}` stands for the given name.", '```\nexport CACHE_DIR="${HOME}/cache"\n```', 'TEMPLATE = "Hello {{ user.name }}, welcome to ${TEAM}"', 'printf("%s of %d rows", name, n) prints the counter.', "Our price list uses $A$ and #B# as row labels, see row 42.", "[Action] check the list, [Owner] the whole team, [Status] done.", "Curly braces: a JSON path such as {a: {b: 1}} is kept.", "It turns ids into <guid> and locales into <locale>.", "Users who turned JavaScript off see a notice that asks them to enable JavaScript.", "Slide 16 still had lorem ipsum as a title, Emre replaced it.", "Description", "x " * 100_000]


def test_residue(spark):
    docs = [(i, t, f"h{i % 3}") for i, t in enumerate(BAD)] + [(100 + i, t, None) for i, t in enumerate(GOOD)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in residue.excluded(df).collect()) == list(range(len(BAD)))
    assert residue.clean(df).count() == len(GOOD)
    assert residue.excluded(df.limit(0)).count() == 0


def test_furniture_is_subtracted(spark):
    notice = "Please enable JavaScript to view this conversation."
    docs = [(i, f"{notice}\nText number {i} tells its own story.", "all") for i in range(40)] + [(100 + i, notice if i == 0 else f"Real text {i}.", "one") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert [r.doc_id for r in residue.excluded(df).collect()] == [100]


def furnished(line, n, host="all", first=0):
    return [(first + i, line(i), host) for i in range(n)]


def test_evidence_of_its_own_is_never_furniture(spark):
    notice, story = "Please enable JavaScript to view this conversation.", "Text number {} tells its own story."
    cases = [lambda i: "404 Not Found", lambda i: f"404 Not Found\nError {500 + i}", lambda i: f"{story.format(i)}\n\n{notice}", lambda i: f"{story.format(i)}\n- {notice}", lambda i: f"<p>{notice}</p><p>{story.format(i)}</p>", lambda i: f"Dear {{{{first_name}}}},\n{story.format(i)}", lambda i: f"The same head of every page\n{notice}"]
    for n in (1, 2, 19, 20, 40):
        docs = [row for k, case in enumerate(cases) for row in furnished(case, n, f"h{k}", 100 * k)]
        df = spark.createDataFrame(docs, "doc_id long, text string, source string")
        assert sorted(r.doc_id for r in residue.excluded(df).collect()) == sorted(d for d, _, _ in docs)


def test_furniture_is_judged_by_share_alone(spark):
    notice = "Please enable JavaScript to view this conversation."
    for n in (4, 19, 20, 40):
        docs = furnished(lambda i: f"{notice}\nText number {i} tells its own story.", n)
        rare = furnished(lambda i: f"{notice if i == 0 else 'Hello'}\nText number {i} tells its own story.", n, "rare", 100)
        copies = [(200 + i, f"{notice}\nOne text, sent again.", "copies") for i in range(n)]
        df = spark.createDataFrame(docs + rare + copies, "doc_id long, text string, source string")
        assert sorted(r.doc_id for r in residue.excluded(df).collect()) == [100, *range(200, 200 + n)]


def test_every_occurrence_of_a_line_counts(spark):
    docs = ["Bullet 1\nBullet 2\nBullet 3", "Heading 1\n\nHeading 2", "Plan\n\nHeading 1\nWe start on Monday.\n\nHeading 2\nWe end on Friday.", "the #name# of it\nthe #NAME# of it", "Heading 1\nWe start on Monday."]
    df = spark.createDataFrame([(i, t, f"h{i}") for i, t in enumerate(docs)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in residue.excluded(df).collect()) == [0, 1, 2, 3]


def test_exchanged_names_beyond_the_bound(spark):
    other = {"Ashkovane": "Berzanova", "Berzanova": "Ashkovane", "Ostfield": "Stonestedt", "Stonestedt": "Ostfield"}
    copy = " ".join(other.get(w, w) for w in PASSAGE.split())
    docs = spark.createDataFrame([(1, copy), (1, copy), (2, PASSAGE), (3, None), (4, "word " * 20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short"), (3, None)], "item_id long, passage string")
    for bound in (leaks.BOUND, 3, 0):
        assert [tuple(x)[:3] for x in leaks.reparameterised(docs, items, bound=bound).collect()] == [(1, 1, 1)]
        assert sorted(map(tuple, leaks.leaks(docs, items, bound=bound).collect())) == [(2, 1)]


def test_copies_with_other_values_are_found(spark):
    """Passages of the given items with other numbers, names and units; and texts that are no copies. Recall and precision at least 0.9."""
    import os
    import re

    path = "/root/testdata/sf0.001/eval_items.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    r, items = random.Random(3), spark.read.parquet(path)
    names = {x.word for x in leaks.vocabulary(items).filter("is_name").collect()}
    passages = {x.item_id: x.passage for x in items.collect()}

    def copy(text, consistent=True):
        given = {}

        def other(m):
            w = m.group()
            if w[0].isdigit():
                return str(r.choice([r.randint(2, 999), f"{r.randint(1, 9)},{r.randint(100, 999)}"]))
            if w.casefold() not in names:
                return w
            new = "".join(r.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(3)).capitalize() + r.choice(["", "", " Tarn"])
            return given.setdefault(w, new) if consistent else new

        return re.sub(r"\w+", other, text)

    docs, truth = [], {}
    for n, (i, p) in enumerate(sorted(passages.items())):
        docs.append((n, f"Some notes first. {copy(p)} And more after it."))
        truth[n] = i
        words_ = p.split()
        docs.append((1000 + n, " ".join(r.sample(words_, len(words_)))))  # the same words in another order
        docs.append((2000 + n, p))  # a leak, no copy with other values
        docs.append((3000 + n, " ".join("maybe" if k % 5 == 4 else w for k, w in enumerate(words_))))
        docs.append((4000 + n, " ".join(str(r.randint(1, 999)) for _ in range(60))))
    got = leaks.reparameterised(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    classes = {}
    for x in got:
        classes.setdefault(x.doc_id, set()).add(x.item_id)
    hits = sum(n in classes for n in truth)
    print(f"re-parameterised: recall {hits / len(truth):.3f}, precision {hits / len(classes):.3f}, rows a document {len(got) / len(classes):.2f}")
    assert hits >= 0.9 * len(truth) and hits >= 0.9 * len(classes) and len(got) <= 6 * len(classes)  # a passage is several sentences, each of a class


def test_long_lines_open_fences_and_other_wordings(spark):
    long = "Please enable JavaScript to view this conversation, " + "and then read on " * 40 + "until it ends."
    bad = [
        long, "```\ncode = 1\n\nPlease enable JavaScript to view this conversation.\nDear {{first_name}},", "We're sorry, the page you requested could not be found.", "The page you are looking for does not exist.",
        "Sorry, this page isn't available.", "Lorem ipsum dolor sit", "Type something. Type something.", "Ceci est un texte factice destiné à remplir la zone. Votre texte ici.", "Este es un texto de relleno para ocupar el espacio. Escriba aquí.",
        "Pagina non trovata", "De pagina bestaat niet", "Страница не найдена", "ページが見つかりません", "Per favore, abilita JavaScript per continuare.", "Schakel JavaScript in om deze pagina te bekijken.", "请启用JavaScript",
    ]
    good = ["```\nprint('{{first_name}}')\n```\nThat is the template.", "```\nexport A=\"${HOME}\"\nDear {{first_name}}", "The page you are looking for is in the wiki, next to the plan.", "I can type something into the box and it stays.", "We moved the page, so the old link does not exist in the guide any more; use the new one."]
    df = spark.createDataFrame([(i, t, f"h{i}") for i, t in enumerate(bad + good)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in residue.excluded(df).collect()) == list(range(len(bad)))


def test_a_dead_host_is_excluded(spark):
    df = spark.createDataFrame([(i, "404 Not Found", "dead") for i in range(40)] + [(100 + i, f"404 Not Found\nnginx/1.{i}.2", "dead2") for i in range(40)], "doc_id long, text string, source string")
    assert residue.excluded(df).count() == 80
