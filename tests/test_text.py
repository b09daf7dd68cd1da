import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import numwords
from corpusloom.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(("arabic", "persian"), [("ي", "ی"), ("ك", "ک"), ("ة", "ه"), ("أإٱ", "ااا"), ("ؤ", "و"), ("ئ", "ی"), ("ى", "ی"), ("کتاب یک", "کتاب یک")])
def test_letters(spark, arabic, persian):
    assert one(spark, arabic, T.to_persian) == persian
    assert one(spark, arabic, T.has_arabic) == (arabic != persian)


def test_marks(spark):
    marked = "".join("ا" + chr(c) for c in (0x64B, 0x652, 0x670, 0x6D6, 0x6ED))
    assert one(spark, marked, T.without_marks) == "ا" * 5
    assert one(spark, marked, T.without_vowels) == "ااااۖاۭ"
    assert one(spark, marked, T.has_marks) and not one(spark, "ا", T.has_marks)


def test_fingerprint(spark):
    assert one(spark, "ا‌ب\tپ ،_! ّ😀", T.fingerprint) == "ابپ_"
    assert one(spark, "", T.fingerprint) == ""
    assert one(spark, None, T.fingerprint) is None


NUMBERS = [("125", "صد و بیست و پنج"), ("۱۲۵", "صد و بیست و پنج"), ("١٢٥", "صد و بیست و پنج"), ("1۲٥", "صد و بیست و پنج"), ("007", "هفت"), ("0", "صفر"), ("000", "صفر"), ("1000", "یک هزار"), ("2010", "دو هزار و ده"),
           ("1000000", "یک میلیون"), ("१२", "دوازده"), ("1" * 25, "1" * 25), ("᠑᠒", "دوازده"), ("𑁧𑁨", "دوازده")]


@pytest.mark.parametrize(("digits", "words"), NUMBERS)
def test_numbers(spark, digits, words):
    assert numwords.spell(digits) == words
    got = one(spark, f"x{digits}y", T.numbers_as_words)
    assert got == (f"x{digits}y" if len(digits) > numwords.MOST else f"x {words} y")


def test_numbers_in_text(spark):
    assert one(spark, "1.5", T.numbers_as_words) == " یک . پنج "
    assert one(spark, "متن", T.numbers_as_words) == "متن"
    assert one(spark, None, T.numbers_as_words) is None
    assert one(spark, None, T.Profile()) == ""


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x86F, exclude_categories=("Cs",)), max_size=30), min_size=1, max_size=20))
def test_against_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.letters_only(F.col("t")).alias("a"), T.word_count(F.col("t")).alias("n"), T.char_count(F.col("t")).alias("c")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.a == re.sub(r"[^\w]", "", t)
        assert r.n == len(t.split())
        assert r.c == len(t)


def test_short(spark):
    assert one(spark, "آ" * 14, T.is_short) and one(spark, "یک دو سه که بلند است", T.is_short) is False
    assert one(spark, "سه واژهٔ بلندبلندبلند", T.is_short)


def test_scoring_form(spark):
    assert one(spark, " كتاب‌ها، خوب! ", T.for_scoring) == "کتاب‌ها خوب"


def test_logs(spark):
    log = "a\n\n'train_runtime': 12.5,\n" + "x" * 200 + "\nlast\n"
    assert one(spark, log, lambda c: T.number_after(c, "'train_runtime': " + T.NUMBER)) == 12.5
    assert one(spark, log, lambda c: T.number_after(c, "'none': " + T.NUMBER)) is None
    assert one(spark, log, lambda c: T.last_lines(c, 2)) == ["x" * 160, "last"]
    assert one(spark, "a", lambda c: T.last_lines(c, 6)) == ["a"]
    assert one(spark, " a, b ,c", T.comma_list) == ["a", "b", "c"]
    assert one(spark, "a,b", lambda c: T.comma_list(c, ("a", "b"))) == ["a", "b"]
    with pytest.raises(Exception, match="unknown: c"):
        one(spark, "a,c", lambda c: T.comma_list(c, ("a", "b")))


def test_log_fields(spark):
    log = "{'train_runtime': '801.5', 'eval_runtime':  61.5}\n[PEAK VRAM] 11.75 GiB"
    assert [one(spark, log, lambda c, p=p: T.number_after(c, p)) for p in T.LOG_FIELDS.values()] == [801.5, 61.5, None, None, 11.75]
