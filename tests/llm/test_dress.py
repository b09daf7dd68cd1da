import json
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import dress, forms, stream


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), max_size=20), max_size=8))
def test_stream_equals_letters(texts):
    sym, starts = stream.fold(list(texts))
    for i, t in enumerate(texts):
        got = "".join(map(chr, sym[starts[i] : starts[i + 1]]))
        if all(ord(c) < 0x250 or 0x600 <= ord(c) < 0x700 or 0x2000 <= ord(c) < 0x2070 for c in t) and not any(0x300 <= ord(c) < 0x370 or 0x610 <= ord(c) < 0x61B or 0x653 <= ord(c) < 0x660 or 0x6D6 <= ord(c) < 0x6EE for c in t):
            assert got == forms.letters(forms.shape(t)), ascii(t)
    h = stream.hashes(sym, starts)
    assert len(h) == len(texts)


def test_hash_is_of_the_symbols():
    a, sa = stream.fold(["Ab, c!", "abc", "", "acb", None, "a" * 100_000, "a" * 99_999])
    h = stream.hashes(a, sa)
    assert h[0] == h[1] and h[2] == h[4] and len({int(x) for x in h}) == 5
    assert stream.equal_streams(["Ab, c!", "abc", "x"], ["a b c", "abd", "xy"]).tolist() == [True, False, False]
    assert len(stream.hashes(*stream.fold([]))) == 0


def test_record_keys():
    a = '{"Clip": 7, "text": "\\u0633\\u0644\\u0627\\u0645، دنیا", "speaker": null}'
    b = ' {"SPEAKER":null,"TEXT":"سَلام دنیا!","clip":7.0}\n'
    assert dress.record_key(a) == dress.record_key(b)
    for other in ('{"clip": 8, "text": "سلام دنیا", "speaker": null}', '{"clip": 7, "text": "سلام دنیا", "speaker": ""}', '{"clip": 7, "text": "سلام دنیا"}', '{"clip": "7", "text": "سلام دنیا", "speaker": null}'):
        assert dress.record_key(other) != dress.record_key(a)
    assert dress.record_key(a[:-5]) is None and dress.record_key("[1]") is None and dress.record_key(None) is None
    assert dress.record_key('{"a": [1, 2]}') != dress.record_key('{"a": [2, 1]}')


def run(spark, rows, records=False):
    df = spark.createDataFrame(rows, "id long, text string").withColumn("h", F.lit(1))
    r = dress.text_rows(df, "t", "id", "text")
    none = dress.text_rows(df.limit(0), "none", "id", "text")
    return {(x.keep_id, x.copy_id) for x in dress.text_copies(none if records else r, r if records else none).collect()}


def test_copies(spark):
    t = "این یک جمله بلند آزمایشی است"
    rows = [(9, t), (2, t + "!"), (5, t.replace(" ", "  ").upper()), (5, t.replace(" ", "  ").upper()), (7, t.replace("ی", "ي")), (1, "بله"), (3, "بله!"), (4, None), (6, ""), (None, t), (8, "naïve résumé studio"), (10, "naïve résumé ѕtudіо")]
    assert run(spark, rows) == {(2, 5), (2, 7), (2, 9), (8, 10)}
    assert run(spark, []) == set()
    rows = [(1, '{"a":1,"b":"x"}'), (2, '{"b": "X!", "a": 1}'), (3, '{"a":1'), (4, '{"a":1'), (5, '{"a":2,"b":"x"}')]
    assert run(spark, rows, records=True) == {(1, 2)}


def test_collisions_are_told_apart(spark):
    """All rows under one hash: the comparison alone decides."""
    texts = ["abcdefghijklmnopq", "Abcdefghijklmnop-q", "qponmlkjihgfedcba", "q ponmlkjihgfedcba", "qponmlkjihgfedcbb"]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tab string, id long, text string")
    hashed = dress.stored(rows).select("tab", "id", "s", F.lit(1).cast("bigint").alias("h"), F.lit(17).alias("n"))
    assert {(r.keep_id, r.copy_id) for r in dress.copies(hashed, rows).collect()} == {(0, 1), (2, 3)}


def test_texts_of_one_id(spark):
    """Two texts under one id, shared with another id: each is matched by its own hash."""
    a, b = "این یک جمله بلند آزمایشی است", "این جمله دیگر هم بلند است"
    assert run(spark, [(1, a), (1, b), (2, a + "!"), (2, b + "."), (3, b)]) == {(1, 2), (1, 3)}


def test_against_grouping(spark, sf):
    want = set()
    for tab, key, col in (("raw_clips", "id", "text_raw"), ("train_clips", "id", "cleaned_text"), ("manifest_lines", "line_id", "payload")):
        groups = defaultdict(set)
        for r in spark.read.parquet(f"{sf}/{tab}.parquet").select(key, col).collect():
            if r[1] and col != "payload":
                k = forms.letters(forms.shape(r[1]))
                if len(k) >= 15:
                    groups[k].add(r[0])
            elif r[1]:
                try:
                    o = json.loads(r[1])
                except ValueError:
                    continue
                groups[tuple(sorted((k.lower(), forms.letters(forms.shape(v)) if isinstance(v, str) else repr(v)) for k, v in o.items()))].add(r[0])
        want |= {(tab, min(g), i) for g in groups.values() for i in g if i > min(g)}
    got = {tuple(r) for r in dress.p6_found(spark, sf).collect()}
    assert {w for w in want if w[0] != "raw_clips"} == {g for g in got if g[0] != "raw_clips"}
    assert want <= got  # look-alike letters may join more
    assert np.all([k < c for _, k, c in got])


def test_words_stored_in_other_forms_attest(spark):
    """The unspoilt copies of a word may all be full-width, decomposed or hold an invisible character."""
    tail = " and some more words"
    pairs = [("ｖｏｌｌｅｙｂａｌｌ", "vоllеybаll"), ("cafe\u0301teria", "c\u0430f\u00e9teria"), ("trac\u200btor", "tr\u0430ctor")]
    rows = [(2 * i + k, w + tail * (i + 1)) for i, p in enumerate(pairs) for k, w in enumerate(p)]
    df = dress.text_rows(spark.createDataFrame(rows, "id long, text string"), "t", "id", "text")
    assert {(r.keep_id, r.copy_id) for r in dress.text_copies(df).collect()} == {(0, 1), (2, 3), (4, 5)}
