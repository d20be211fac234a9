from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewire import functions as fn


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        (None, ""), ("", ""), (" \t\n ", ""), ("a  b\n c", "a b c"), ("see http://x.y/z now", "see now"), ("mail me@x.org #tag @who ok", "mail ok"), ("#café!", "!"),
        ("HTTP://x stays", "HTTP://x stays"), ("x😀y", "xy"), ("it’s “so”", "it's \"so\""), ("cafÃ©", "café"), ("a &amp; b", "a & b"), ("<b>&amp;</b>", "<b>&amp;</b>"), ("ﬁne\r\nday", "fine day"), (" x　", "x"),
    ],
)
def test_clean_text(spark, text, clean):
    assert one(spark, text, fn.clean_text) == clean


def test_cleaning_twice_is_cleaning_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(fn.clean_text(F.col("text")).alias("a"))
    assert df.where(F.col("a") != fn.clean_text(F.col("a"))).count() == 0


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2025-07-04", date(2025, 7, 4)), ("07/04/2025", date(2025, 7, 4)), ("4 July 2025", date(2025, 7, 4)), ("Jul 4, 2025 3:05 PM", date(2025, 7, 4)), ("2025-07-04T23:59:00+02:00", date(2025, 7, 4)),
        ("", None), ("  ", None), ("bogus", None), (None, None),
    ],
)
def test_parse_date(spark, text, day):
    assert one(spark, text, fn.parse_date) == day


def test_relative_dates_and_periods(spark):
    at = F.lit(date(2025, 7, 6))
    assert one(spark, "2 days ago", lambda c: fn.parse_date(c, as_of=at)) == date(2025, 7, 4)
    assert one(spark, "yesterday", lambda c: fn.parse_date(c, as_of=at)) == date(2025, 7, 5)
    assert one(spark, date(2025, 7, 6), fn.week_start, "date") == date(2025, 6, 30)  # a Sunday belongs to the week before
    assert one(spark, date(2025, 7, 7), fn.week_start, "date") == date(2025, 7, 7)
    assert one(spark, date(2025, 7, 7), fn.month_start, "date") == date(2025, 7, 1)


@pytest.mark.parametrize(("text", "n"), [("12000", 12000.0), (" 12 ", 12.0), ("1,234", None), ("n/a", None), ("1d", None), ("nan", None), (None, None), ("-1.5e3", -1500.0)])
def test_to_number(spark, text, n):
    assert one(spark, text, fn.to_number) == n


def test_tags_sentiment_source_words(spark):
    assert one(spark, " nhs, policy,,nhs , Mixed", fn.split_tags) == ["nhs", "policy", "nhs", "Mixed"]
    assert one(spark, None, fn.split_tags) == [] == one(spark, " , ", fn.split_tags)
    assert [one(spark, s, fn.sentiment_score) for s in ("Positive", " negative ", "NEUTRAL", "mixed", None)] == [1.0, -1.0, 0.0, None, None]
    assert [one(spark, s, fn.sentiment_bin, "double") for s in (0.06, -0.06, 0.05, None)] == ["Positive", "Negative", "Neutral", "Neutral"]
    assert one(spark, "  HTTPS://www.Daily   Sun/ ", fn.normalize_source) == "daily sun"
    assert one(spark, "BBC News", lambda c: fn.normalize_source(c, {"bbc news": "bbc"})) == "bbc"
    assert one(spark, "", fn.word_count) == 0 and one(spark, "a b", fn.word_count) == 2
    assert one(spark, "A bb c_d é1 x", fn.tokens) == ["bb", "c_d", "é1"]


DATES = [
    ("Friday, 4th July 2025", date(2025, 7, 4)), ("le 4 juillet 2025", date(2025, 7, 4)), ("Vendredi 1er août 2025 à 15:05", date(2025, 8, 1)), ("4. März 2025", date(2025, 3, 4)), ("Freitag, den 4. Okt. 2025, 9:30 Uhr", date(2025, 10, 4)),
    ("4 de julio de 2025", date(2025, 7, 4)), ("viernes 4 dic 2025", date(2025, 12, 4)), ("4 luglio 2025", date(2025, 7, 4)), ("Sabato 29 feb 2020", date(2020, 2, 29)), ("1º de março de 2025", date(2025, 3, 1)),
    ("Sept 9, 1999 12:00:01.5 am UTC", date(1999, 9, 9)), ("2025 Jul 4", date(2025, 7, 4)), ("20250704", date(2025, 7, 4)), ("2025/7/4", date(2025, 7, 4)), ("04-07-2025", date(2025, 7, 4)), ("4.7.2025", date(2025, 7, 4)),
    ("7/4/25", date(2025, 7, 4)), ("13/4/2025", date(2025, 4, 13)), ("4 Jul 69", date(1969, 7, 4)), ("Jul 4, 2025 3 PM", date(2025, 7, 4)), ("2025-07-04 23:59:59", date(2025, 7, 4)), (" JULY 4 2025\n", date(2025, 7, 4)),
    ("29 Feb 2025", None), ("31/31/2025", None), ("July 2025", None), ("4 July", None), ("2025", None), ("4 Julx 2025", None), ("jui 4 2025", None), ("4 5 July 2025", None), ("2025-13-01", None), ("12:30", None), ("7/4/025", None),
    ("x" * 100_000, None), ("4 July 2025 and more words", None), ("?", None), ("00000000", None),
]


def test_free_dates(spark):
    got = spark.createDataFrame([(t,) for t, _ in DATES], "t string").select("t", fn.parse_date(F.col("t")).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == DATES


def test_which_number_is_the_day(spark):
    for text, first, second in (("07/04/2025", date(2025, 4, 7), date(2025, 7, 4)), ("07-04-2025", date(2025, 4, 7), date(2025, 7, 4)), ("13/04/2025", date(2025, 4, 13), date(2025, 4, 13)), ("04/13/2025", date(2025, 4, 13), date(2025, 4, 13))):
        assert one(spark, text, lambda c: fn.parse_date(c, day_first=True)) == first and one(spark, text, lambda c: fn.parse_date(c, day_first=False)) == second
    assert one(spark, "4 juillet 2025", lambda c: fn.parse_date(c, languages=("en", "de"))) is None


def twice(text, encoding):
    return text.encode().decode(encoding).encode().decode(encoding)


MISREAD = [
    (twice("é", "cp1252"), "é"), (twice("naïve café", "latin-1"), "naïve café"), ("Łódź – ż".encode().decode("latin-1"), "Łódź – ż"), ("é – ok".encode().decode("mac_roman"), "é – ok"), ("ż".encode().decode("cp1250"), "ż"),
    ("Привет".encode().decode("latin-1"), "Привет"), ("😀 ok".encode().decode("latin-1"), "😀 ok"), ("e\u0301", "é"), ("\u1112\u1161\u11ab", "한"), ("\u212b", "Å"), ("a\u0323\u0307", "ạ\u0307"), ("a\u0307\u0323", "ạ\u0307"),
    ("CAFÉ”", "CAFÉ”"), ("naïve “ÀÉ” Ünïcödé ß", "naïve “ÀÉ” Ünïcödé ß"), ("MAÇÃ, SÃO", "MAÇÃ, SÃO"), ("Łódź", "Łódź"), ("Привет «мир»", "Привет «мир»"), ("漢字かな 한국어", "漢字かな 한국어"), ("", ""), (None, None), ("plain", "plain"),
]


def test_repair(spark):
    got = spark.createDataFrame([(t,) for t, _ in MISREAD], "t string").select("t", fn.repair(F.col("t")).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == MISREAD


def test_all_composed_code_points(spark):
    import unicodedata

    whole = [chr(c) for c in range(0x80, 0x30000) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    got = spark.createDataFrame([(c, unicodedata.normalize("NFD", c)) for c in whole], "c string, d string").select("c", fn.repair(F.col("d")).alias("d"), fn.repair(F.col("c")).alias("e")).collect()
    assert len(got) > 12_000 and all(r["d"] == r["e"] == unicodedata.normalize("NFC", r["c"]) for r in got)


def test_texts_of_the_tables_need_no_repair(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert df.where(fn.repair(F.col("text")) != F.col("text")).count() == 0


def test_many_inner_blanks_are_stripped_at_once(spark):
    import time

    text = "a" + " " * 200_000 + "b"
    began = time.time()
    assert one(spark, f" \u3000{text}\x85 ", fn.strip) == text and time.time() - began < 20


def test_only_misread_text_is_sent_to_python(spark):
    """Accented letters side by side are no misread text; all that repaired() changes is looked at, in the middle of ASCII too."""
    import importlib
    import random

    repair = importlib.import_module("tidewire.functions.repair")
    rng = random.Random(5)
    texts = ["créée à Noël, ñíñó éçê", "plain", "ﬁ e\u0301"]
    for e in repair.ENCODINGS:
        for _ in range(60):
            true = "".join(rng.choice("éñß–’€ąЖ😀☀") for _ in range(rng.randrange(1, 4)))
            texts.append("a " + "".join(bytes([b]).decode(e, "ignore") or chr(b) for b in true.encode()) + " é z")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select("t", repair.foreign(F.col("t")).rlike(repair.SUSPICIOUS).alias("s"), repair.repair(F.col("t")).alias("r"))
    got = df.collect()
    assert not got[0]["s"] and not got[1]["s"]
    assert all(r["r"] == repair.repaired(r["t"]) for r in got) and sum(r["r"] != r["t"] for r in got) > 100


def test_white_space_noise_and_emoji_in_any_text(spark):
    texts = ["a \n b\x1c\x1dc", "a\t\té\u3000 z", "\x85a\u2028b", "one  two   ", "x http://a#b c@d #e @f", "é\u200d☀ é", "a  ☀  b", "HTTP a&nbsp;&nbsp;b"]
    want = ["a b c", "a é z", "a b", "one two", "x", "é é", "a b", "HTTP a b"]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(fn.clean_text(F.col("t"))).collect()] == want
