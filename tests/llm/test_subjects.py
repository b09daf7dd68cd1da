import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import subjects

AREAS = {s: [f"{s}{s}term{i}" for i in range(20)] for s in "abcdef"}
PLAIN = [f"word{i}" for i in range(300)]


def corpus(n=800, seed=1):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = r.sample(list(AREAS), r.choice([0, 1, 1, 2]))
        sentences = []
        for s in own:
            sentences += [[r.choice(AREAS[s]) if r.random() < 0.6 else r.choice(PLAIN) for _ in range(10)] for _ in range(6)]
        sentences += [[r.choice(PLAIN) for _ in range(10)] for _ in range(r.randint(4, 6))]
        if r.random() < 0.3:
            sentences[-1][0] = r.choice(AREAS["a"])  # a stray term
        r.shuffle(sentences)
        docs.append((i, r.choice([". ", "! ", ".\n"]).join(" ".join(s) for s in sentences)))
        truth[i] = set(own)
    return docs, truth


def words_of_numbers(text):
    """Digits spelled with letters, so that terms are words."""
    return "".join(chr(ord("a") + int(c)) + "q" if c.isdigit() else c for c in text)


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    docs = [(i, words_of_numbers(t)) for i, t in docs]
    labels = [(i, s) for i in range(0, 200) for s in (truth[i] or {None})] + [(0, "unknown subject"), (99_999, "a"), (3, "b")]
    d = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, "x y z")], "doc_id long, text string").withColumn("subject", F.lit("clash"))
    found = subjects.subject_shares(d, spark.createDataFrame(labels + labels[:9], "doc_id long, subject string"), spark.createDataFrame([(s,) for s in [*AREAS, "empty"]], "subject string"))
    got = {(r.doc_id, r.subject) for r in found.filter(F.col("share") >= subjects.SHARE).collect()}
    want = {(i, s) for i, own in truth.items() for s in own}
    held = lambda x: {p for p in x if p[0] >= 200}
    right = len(held(got) & held(want))
    assert right / len(held(got)) > 0.97 and right / len(held(want)) > 0.97


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    l, a = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("a",)], "subject string")
    assert subjects.subject_shares(d, l, a).count() == 0
    some = spark.createDataFrame([(1, "one two three four."), (2, "one two five six.")], "doc_id long, text string")
    assert subjects.subject_shares(some, l, a).count() == 0


@pytest.mark.parametrize(("word", "stem"), [("کتابها", "کتاب"), ("کتابهایشان", "کتاب"), ("سمها", "سم"), ("قهرمانهای", "قهرمان"), ("دفتر", "دفتر"), ("ها", "ها")])
def test_endings(word, stem):
    assert subjects.bucket(word) == subjects.bucket(stem)


def test_tokens():
    flat, sizes, terms, sentences, latin = subjects.tokens(["یک دو سه. چهار پنج شش هفت\nهشت نه", "", "one two three?"], subjects._lut(), subjects.Memo())
    assert sizes == [3, 4, 3] and terms == [7, 0, 3] and sentences == [2, 0, 1] and len(flat) == 10 and latin.tolist() == [False, False, True]


def test_look_alikes_are_repaired(spark):
    """A word spoilt with Cyrillic letters gives its own term; letters that are no look-alikes stay a word."""
    d = spark.createDataFrame([(1, "the volleyball match, referee"), (2, "the vоllеуbаll mаtch, rеfеrее"), (3, "слово и ещё слово"), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in subjects.repaired(d).collect()}
    assert rows == {1: "the volleyball match, referee", 2: "the volleyball match, referee", 3: "слово и ещё слово", 4: None}
    terms = {r.doc_id: (r.terms, r.latin) for r in subjects.repaired(d.filter("text IS NOT NULL")).mapInArrow(subjects._terms, subjects.TERMS).collect()}
    assert terms[1] == terms[2] == ([subjects.bucket(w) for w in ("the", "volleyball", "match", "referee")], True)
    assert terms[3] == ([subjects.bucket(w) for w in ("слово", "и", "ещё", "слово")], False)


def test_words_of_shaped_texts(spark):
    """Full-width, decomposed and invisibly parted words attest their plain form."""
    from corpusloom.llm import lookalikes

    d = spark.createDataFrame([("ｈａｒｖｅｓｔ",), ("cafe\u0301",), ("trac\u200btor",), ("plain",), ("بدون",), (None,)], "text string")
    assert {r.word for r in lookalikes.shaped_words(d, "text").collect()} == {"harvest", "café", "tractor", "plain"}
