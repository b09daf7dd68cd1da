import random

import numpy as np
import pytest

from corpusloom.llm import forms, leaks

R = random.Random(5)
WORDS = ["".join(R.choice("ابپتدرسشعفقکلمنوهی") for _ in range(R.randint(2, 8))) for _ in range(300)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_against_word_runs(spark):
    items = [(i, text(40)) for i in range(20)] + [(100, "کوتاه"), (101, None), (102, "")]
    docs = []
    for i in range(60):
        t = text(80).split()
        if i % 2:
            w = items[i % 20][1].split()
            n = R.choice([8, 11, 12, 13, 25, 40])
            s = R.randint(0, 40 - n)
            t[30:30] = w[s : s + n]
        sep = R.choice([" ", "  ", "، ", ".\n"])
        docs.append((i, sep.join(t)))
    docs += [(200, None), (201, ""), (202, text(30) + " " + items[3][1].replace("ی", "ي") + " " + text(30)), (202, text(5)), (203, (text(50) + " ") * 400 + items[4][1])]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    runs = lambda t: {tuple(w[k : k + 12]) for w in [forms.words(forms.shape(t or ""))] for k in range(len(w) - 11)}
    of = {i: runs(t) for i, t in items}
    want = {(i, j) for i, t in docs for j in of if runs(t) & of[j]}
    got = [tuple(r) for r in leaks.leaks(d, it, "doc_id", "text", "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (202, 3) in want and (203, 4) in want
    blocks = {tuple(r) for r in leaks.leaks(d, it, "doc_id", "text", "item_id", "text", block=500).collect()}
    assert blocks == want
    assert leaks.leaks(d, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.leaks(d.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0
    with pytest.raises(ValueError, match="edits"):
        leaks.leaks(d, it, "doc_id", "text", "item_id", "text", edits=99)


def test_one_edit_is_found(spark):
    item = text(40)
    w = item.split()
    near = w[:12]
    k = 6
    near[k] = near[k][:1] + "ژ" + near[k][1:]
    ready = leaks.prepare([1], [item])
    doc = f"{text(30)} {' '.join(near)} {text(30)}"
    assert leaks.matches([doc], ready, exact=False) == [(0, 0)] and leaks.matches([doc], ready, exact=True) == []
    assert leaks.matches([text(60), None, ""], ready, exact=False) == []


def test_lookalikes_in_a_passage():
    item = f"{text(15)} studio {text(15)}"
    ready = leaks.prepare([1], [item])
    assert leaks.matches([item.replace("studio", "ѕtudіо")], ready) == [(0, 0)]


def test_qgrams_and_squeeze():
    s = np.array([32, 97, 32, 32, 98, 32, 99, 32, 32], np.int32)
    out, starts = leaks.squeeze(s, np.array([0, 6, 6, 9]))
    assert out.tolist() == [97, 32, 98, 1, 1, 99, 1] and starts.tolist() == [0, 4, 5, 7]
    a = leaks.qgrams(np.arange(40) % 10, 8)
    assert len(a) == 33 and a[0] == a[10] == a[20] and len(set(a[:10].tolist())) == 10
    assert len(leaks.qgrams(np.arange(5), 8)) == 0


def test_spoilt_items_are_repaired(spark):
    """An item spoilt with look-alikes meets the plain document, and the other way round, and two spoilt in different ways."""
    a, b = text(15), text(15)
    plain, one, two = (f"{a} {w} {b[:40]} {w} {b}" for w in ("studio", "ѕtudіо", "studiо"))
    docs = spark.createDataFrame([(1, plain), (2, one), (3, two), (4, text(30) + " studio")], "doc_id long, text string")
    items = spark.createDataFrame([(10, one), (11, plain), (12, None)], "item_id long, text string")
    got = {tuple(r) for r in leaks.leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(d, i) for d in (1, 2, 3) for i in (10, 11)}


def test_edited_passages(spark):
    """Every kind of edit within the budget is found and shorter passages are not, against a plain scan by edit distance."""
    item = text(40)
    w = item.split()
    passage = " ".join(w[5:17])
    k = passage.index(" ", 20) + 1
    edited = {1: passage[:k] + "ژ" + passage[k:], 2: passage[:k] + passage[k + 1 :], 3: passage[:k] + "ژ" + passage[k + 1 :], 4: " ".join(w[5:11]), 5: passage}
    docs = spark.createDataFrame([(i, f"{text(20)} {p} {text(20)}") for i, p in edited.items()], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in leaks.leaks(docs, items, "doc_id", "text", "item_id", "text", exact=False).collect()} == {1, 2, 3, 5}
    assert {r.doc_id for r in leaks.leaks(docs, items, "doc_id", "text", "item_id", "text").collect()} == {5}
