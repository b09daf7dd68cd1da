import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def test_rake_meets_the_marginals():
    cells = pd.DataFrame([(s, l, t, 1000 * (i + 1)) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in ("fa", "en") for t in ("x", "y"))], columns=["source", "language", "topic", "n_tokens"])
    source = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 4), "none": (0.1, 4)}
    got = mixing.rake(cells, source, others={"language": {"fa": 0.7, "en": 0.3}})
    tokens = got.weight * got.n_tokens
    by = tokens.groupby(got.source).sum() / tokens.sum()
    assert by["a"] == pytest.approx(0.5 / 0.9) and by["b"] == pytest.approx(0.3 / 0.9) and by["c"] == pytest.approx(0.1 / 0.9)
    assert (got.weight <= got.source.map({"a": 1, "b": 2, "c": 4}) + 1e-9).all()
    free = mixing.rake(cells, {s: (1 / 3, 10) for s in "abc"}, total=3000, others={"language": {"fa": 0.7, "en": 0.3}})
    assert (free.weight * free.n_tokens)[free.language == "fa"].sum() == pytest.approx(2100, rel=1e-6)
    assert len(mixing.rake(cells[:0], source)) == 0 and mixing.rake(cells, {"a": (0.0, 1)}).weight.sum() == 0


def test_mixture(spark):
    rows = [(i, "big" if i % 3 else "small", "fa" if i % 5 else None, "x", 50 + i % 100) for i in range(6000)] + [(9000, None, "fa", "x", 10), (9001, "other", "fa", "x", 10), (9002, "big", "fa", "x", 0), (None, "big", "fa", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, n_tokens long").withColumn("weight", F.lit(1)).withColumn("need", F.lit(1))
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mixture(df, targets)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and max(r.copies for r in rows if r.source == "small") <= 3 and all(r.copies == 1 for r in rows if r.source == "big")
    report = {r.source: r for r in mixing.share_report(out, targets).collect()}
    assert report["big"].actual_share == pytest.approx(1 / 3, abs=0.005) and report["small"].actual_share == pytest.approx(2 / 3, abs=0.005) and report["gone"].n_docs == 0
    assert {(r.doc_id, r.copies) for r in mixing.mixture(df.repartition(7), targets).collect()} == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mixture(df.limit(0), targets).count() == 0
    assert mixing.mixture(df, targets.limit(0)).count() == 0
    m = {(r.dimension, r.value): r for r in mixing.marginals(out, df, targets).collect()}
    assert m["source", "big"].target_share == pytest.approx(1 / 3) and abs(m["source", "big"].reached_share - 1 / 3) < 0.005 and all(r.settled for r in m.values())
    assert ("language", None) in m and m["topic", "x"].reached_share == pytest.approx(1.0) and ("source", "gone") not in m
    assert tuple(mixing.conservation(out, df, targets).first()) == (0, 0, 0, 0, 0)
    bad = out.withColumn("copies", F.lit(9)).unionByName(out.limit(1).withColumn("source", F.lit("other")))
    broken = mixing.conservation(bad, df, targets).first()
    assert broken.over_cap == len(rows) and broken.foreign_source == 1 and broken.repeated_documents == 1
    half = mixing.mixture(df, targets, total=100_000.0).agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert abs(half - 100_000) < 2000


def test_languages(spark):
    rows = [("fa-IR", False), (None, False), ("en", False), ("en_US", True), ("", False), ("ar", False), (None, True)]
    df = spark.createDataFrame(rows, "tag string, latin boolean").select(mixing.language(F.col("tag"), F.col("latin"), ("en", "fa")).alias("l"))
    assert [r.l for r in df.collect()] == ["fa", "fa", "fa", "en", "fa", "ar", "en"]


def test_pieces():
    t = "یک دو سه " * 3000
    parts = list(mixing.pieces(t, 1000))
    assert "".join(parts) == t and len(parts) > 20
    assert list(mixing.pieces("x" * 5000, 1000)) == ["x" * 5000] and list(mixing.pieces("")) == [""]


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary file")
def test_tokens(spark, monkeypatch):
    long = "سلام دنیا، این متن است " * 400
    df = spark.createDataFrame([(1, long), (2, None), (3, "hello world again")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.latin) for r in mixing.token_counts(df, "text").collect()}
    monkeypatch.setattr(mixing, "LONG", 500)
    assert got[2] == (0, False) and got[3][0] >= 3 and got[3][1] and got[1][0] > 1000
    import base64

    import tiktoken

    with open(mixing.TOKENIZER, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    assert got[3][0] == len(enc.encode_ordinary("hello world again"))
    assert got[1][0] == len(enc.encode_ordinary(long)) == sum(len(enc.encode_ordinary(p)) for p in mixing.pieces(long, 500))


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary file")
def test_language_by_the_repaired_text(spark, tmp_path):
    """A spoilt English text goes by Latin letters, but its size is that of the stored text."""
    spoilt = "реaсе реaсе, реaсе"  # all but the a are Cyrillic
    tables = {
        "documents": ([(1, "web", "fa", spoilt), (2, "web", "fa", "peace here"), (3, "web", "fa", "سلام دنیا"), (4, "web", "fa", None)], "doc_id long, source string, lang string, text string"),
        "subject_labels": ([(2, "a")], "doc_id long, subject string"),
        "subject_areas": ([("a",)], "subject string"),
        "mix_targets": ([("web", 1.0, 1)], "source string, target_share double, max_repeats int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: (r.language, r.n_tokens) for r in mixing._inputs(spark, str(tmp_path))[0].collect()}
    stored = {r.doc_id: r.n_tokens for r in mixing.token_counts(spark.createDataFrame(*tables["documents"]), "text").collect()}
    assert got == {1: ("en", stored[1]), 2: ("en", stored[2]), 3: ("fa", stored[3]), 4: ("fa", 0)}
