from pyspark.sql import functions as F

from threadlake.functions.mri import clean_mri, is_bot, is_person
from threadlake.functions.porter import fold, porter
from threadlake.functions.text import plain_text
from threadlake.plans.search import snippet


def test_plain_text():
    assert plain_text("<div>a<br>b &amp;lt; c</div><p>d</p>e") == "a\nb &lt; c\nd\ne".replace("c\nd", "cd")
    assert plain_text("x&nbsp;&#65;&#x42;&unknown;y") == "x AB y"
    assert plain_text("<p>1</p><p>2</p>\n\n\n<p>3</p>") == "1\n2\n\n3"
    assert plain_text("") == ""


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "sky": "sky"}
    assert {w: porter(w) for w in pairs} == pairs
    assert fold("Žélé") == "Zele"


def test_mri(spark):
    df = spark.createDataFrame([(" 8:Orgid:A ",), ("28:bot",), (None,), ("?",)], "m string")
    assert [tuple(r) for r in df.select(clean_mri(F.col("m")), is_person(F.col("m")), is_bot(F.col("m"))).collect()] == [("8:orgid:a", True, False), ("28:bot", False, True), (None, False, False), ("?", False, False)]


def test_snippet():
    assert snippet("one two three four five six seven eight nine ten eleven Twelve!", ["twelve"], 3) == "…ten eleven [Twelve!]"


def test_times_and_glyphs(spark):
    import pytest

    from threadlake.plans import render

    now = 1_760_000_000_000
    assert render.parse_time("-2h", now) == now - 7_200_000 and render.parse_time("+1d", now) == now + 86_400_000
    assert render.parse_time("2025-01-01", now) == 1735689600000 and render.parse_time("1735689600000", now) == 1735689600000
    assert render.parse_time("2025-01-01T10:00", now, "Europe/Berlin") == 1735722000000 == render.parse_time("2025-01-01T09:00Z", now)
    with pytest.raises(ValueError):
        render.parse_time("soon", now)
    df = spark.createDataFrame([(0,), (None,), (1735689600000,), (1704067200000,)], "t long")
    assert [r[0] for r in df.select(render.shown_time(F.col("t"), 1736000000000, "Europe/Berlin")).collect()] == ["--", "--", "01-01 01:00", "2024-01-01 01:00"]
    keys = ["like", "1f44d_thumbsup-tone2", "1f468_200d_1f4bb", "1f468_man;x", "party", None, "", "d83d_x", "110000_x", "LIKE", "plusone;0-x", "abc_x"]
    shown = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", render.glyph(F.col("k")).alias("g")).orderBy("i").collect()
    assert [r.g for r in shown] == ["👍", "👍", "👨‍💻", "👨", "🎉", None, "", "d83d_x", "110000_x", "👍", "👍", "abc_x"]


def test_entities(spark):
    from threadlake.functions.text import plain_text

    assert plain_text("d&iacute;a t&ecirc;te &AMP; &Eacute; &unknown; x") == "día tête & É x".replace("É", "é")
