import pytest
from pyspark.sql import functions as F

from corpusloom.llm import equal_forms, forms, lookalikes

SAME = [
    ("خانه‌ها", "ﺧﺎﻧﻪﻫﺎ"), ("ز‌یر", "زیر"), ("آب", "آب"), ("رائ", "رای"), ("ده‌ها", "دەها"), ("  x… ", "x..."), ("ｎａïｖe", "naïve"), ("خانه‌‌ها​", "خانه‌ها"), ("۱۲", "١٢"),
    ("می خواهم", "می خواهم"), ("ك ي", "ک ی"), ("ﻻ", "لا"), ("مَّ", "مَّ"), ("a\r\nb", "a\nb"), ("خانه‌ ", "خانه"), ("خانهٔ", "خانۀ"),
]
OTHER = [("خانه‌ها", "خانهها"), ("خانه‌ها", "خانه ها"), ("مَن", "من"), ("A", "a"), ("a  b", "a b"), ("a\nb", "a b"), ("۴", "٤"), ("۱", "1"), ("a,", "a،"), ("cafe", "café")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert forms.shape(a) == forms.shape(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert forms.shape(a) != forms.shape(b)


def test_edges():
    assert forms.shape(None) is None and forms.shape("") == "" and forms.shape(" \n‌") == ""
    long = "خانه‌ها " * 50_000
    assert forms.shape(long) == long.strip()
    assert forms.letters(forms.shape("بله، «خانه‌ها» Ok!")) == "بلهخانههاok" and forms.words("خانه‌ها، Ok_2") == ["خانهها", "ok", "2"]
    for a, b in SAME:
        assert forms.shape(forms.shape(a)) == forms.shape(a)


def test_lookalikes(spark):
    vocabulary = spark.createDataFrame([("studio",), ("сок",), ("email",)], "word string")
    tokens = ["ѕtudіо", "еmаіl", "соk", "хyzzy", "studio", "pοdcаst", "рοdcast", None]
    mixed = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {r.token: r.repaired for r in lookalikes.repairs(mixed, vocabulary).filter("token <> repaired").collect()}
    # podcast is in no vocabulary, but two spellings give it; xyzzy has neither
    assert got == {"ѕtudіо": "studio", "еmаіl": "email", "pοdcаst": "podcast", "рοdcast": "podcast"}
    assert lookalikes.repair_text("в ѕtudіо и хyzzy", {"studio"}) == "в studio и хyzzy"


def test_repair_keeps_rows(spark):
    df = spark.createDataFrame([(1, "the studio", "x"), (2, "a ѕtudіо, b", "x"), (2, "a ѕtudіо, b", "x"), (3, None, None), (4, "", "y")], "id int, t string, token string")
    out = lookalikes.repair(df, "t", lookalikes.latin_words(df, "t"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "the studio", "x"), (2, "a studio, b", "x"), (2, "a studio, b", "x"), (3, None, None), (4, "", "y")], key=str)


def test_pairs(spark):
    base = "این یک جمله آزمایشی درباره studio است"
    rows = [(5, base), (3, base.replace("studio", "ѕtudіо")), (9, base.replace("ی", "ي")), (9, base.replace("ی", "ي")), (7, base), (1, base + "!"), (2, "بله"), (4, "بله​"), (6, None), (8, ""), (None, base + " ")]
    df = spark.createDataFrame(rows, "id long, text_raw string").withColumn("form", F.lit("clash"))
    got = {tuple(r) for r in equal_forms.look_same_pairs(df, "id", "text_raw").collect()}
    assert got == {(3, 5), (5, 9), (3, 9), (3, 7), (7, 9)}
    assert equal_forms.look_same_pairs(df.limit(0), "id", "text_raw").count() == 0
    r = equal_forms.form_report(df, "text_raw").first()
    assert r.n_texts == 10 and r.n_forms < r.n_stored


def test_against_pairwise(spark, sf):
    """Every pair by its forms, one by one."""
    rows = [(r.id, r.text_raw) for r in spark.read.parquet(f"{sf}/raw_clips.parquet").select("id", "text_raw").distinct().collect() if r.text_raw]
    known = {w for _, t in rows for w in forms.words(forms.shape(t))}
    shaped = [(i, t, lookalikes.repair_text(forms.shape(t), known)) for i, t in rows]
    want = {(min(a, b), max(a, b)) for a, t, f in shaped for b, u, g in shaped if a < b and t != u and f == g and len(forms.letters(f)) >= 15}
    got = {tuple(r) for r in equal_forms.p2_found(spark, sf).collect()}
    assert got == want
