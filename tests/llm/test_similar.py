from fractions import Fraction
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import cross, forms, near, vectors

S = Fraction(3, 5)


def jaccard(a, b):
    return Fraction(len(a & b), len(a | b))


def variants(seed, n=120):
    import random

    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(words)], [w[k], r.choice(words)]]) if len(w) > 4 else [w[k]]
        else:
            w = r.sample(words, r.randint(5, 16))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_near_equals_all_pairs(spark, seed):
    rows = variants(seed)
    df = spark.createDataFrame(rows + rows[:5] + [(500, None), (501, ""), (None, rows[0][1])], "id long, t string").withColumn("c", F.lit(0)).withColumn("k", F.lit("x"))
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 8 and jaccard(sets[a], sets[b]) >= S}
    got = [tuple(r) for r in near.near_pairs(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    groups = {r.id: r for r in near.near_groups(df, "id", "t").collect()}
    assert set(groups) == {i for i, s in sets.items() if len(s) >= 8}
    assert all(groups[a].group_id == groups[b].group_id for a, b in want)
    assert near.near_pairs(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError, match="min_words"):
        near.near_pairs(df, "id", "t", min_words=1)


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_equal_all_pairs(spark, seed):
    rows = variants(seed, 160)
    held, train = rows[:50], rows[45:]
    h = spark.createDataFrame([(i, t, "val" if i % 2 else "test", "s") for i, t in held] + [(900, None, "val", "s")], "id long, t string, split string, source string")
    t = spark.createDataFrame(train + [(900, "x"), (None, "y")], "id long, t string").withColumn("split", F.lit("clash"))
    got = {(r.held_id, r.train_id) for r in cross.overlaps(h, t, "id", "t", ("split", "source")).collect()}
    a, b = {i: set(x.split()) for i, x in held}, {i: set(x.split()) for i, x in train}
    want = {(i, j) for i in a for j in b if i == j or (min(len(a[i]), len(b[j])) >= 8 and jaccard(a[i], b[j]) >= S)} | {(900, 900)}
    assert got == want
    assert cross.overlaps(h.limit(0), t, "id", "t", ("split",)).count() == 0 and cross.overlaps(h, t.limit(0), "id", "t", ("split",)).count() == 0


def unit_vectors(classes, ratio):
    import numpy as np

    order = vectors.Order(*vectors.frequent(classes.unionByName(classes)), ratio)
    vec = {}
    for r in classes.collect():
        flat = np.array(r.w)
        terms, x = order.sort(flat, np.array([0, len(flat)]))
        vec[r.c] = dict(zip(terms.tolist(), x.tolist(), strict=True))
    return vec


@pytest.mark.parametrize(("ratio", "long", "threshold"), [(1.0, 64, 0.75), (3.0, 64, 0.6), (50.0, 64, 0.4), (50.0, 6, 0.4), (4.0, 0, 0.55)])
def test_cosine_equals_all_pairs(spark, ratio, long, threshold):
    """Also for vectors of one or two terms, pairs that share a single heavy term, and every scheme of lists."""
    rows = variants(7, 60) + [(1000 + i, t) for i, t in enumerate(("w1", "w2", "w1 w2", "rare w1", "rare w2", "rare w3 w4", "other w1", "w1 w2 w3"))]
    c = vectors.classes_of(vectors.members(spark.createDataFrame(rows, "id long, t string"), "id", "t", 1))[1]
    vec = unit_vectors(c, ratio)
    dot = lambda a, b: sum(w * b.get(k, 0) for k, w in a.items())
    want = {(i, j) for i in vec for j in vec if dot(vec[i], vec[j]) >= threshold - 1e-9}
    got = {(r.a, r.b): r for r in cross.cosine_join(c, c, threshold, ratio, long=long).collect()}
    assert set(got) == want
    assert all(abs(r.cosine - dot(vec[i], vec[j])) < 1e-9 and r.common == len(vec[i].keys() & vec[j].keys()) for (i, j), r in got.items())
    if ratio == 50.0:
        assert any(len(vec[i].keys() & vec[j].keys()) == 1 and i != j for i, j in want)
    with pytest.raises(ValueError, match="threshold"):
        cross.cosine_join(c, c, 0.0)


def test_bound_of_the_weights(spark):
    """No pair of similar sets has a lower cosine, whatever the weights."""
    c = vectors.classes_of(vectors.members(spark.createDataFrame(variants(11, 120), "id long, t string"), "id", "t", 4))[1]
    for ratio in (1.0, 2.0, 9.0):
        vec = unit_vectors(c, ratio)
        least = min(sum(w * vec[j].get(k, 0) for k, w in vec[i].items()) for i in vec for j in vec if jaccard(vec[i].keys(), vec[j].keys()) >= S)
        assert least >= cross.bound(S, ratio) - 1e-9
    assert cross.bound(S, 1.0) == pytest.approx(0.75) and cross.bound(S, 2.0) == pytest.approx(0.6)


def long_records():
    import random

    r = random.Random(4)
    words = [f"v{i}" for i in range(9000)]
    base = r.sample(words, 3000)
    rows = [(1, base), (2, base[:2500]), (3, base[:2000] + r.sample(words, 500)), (4, r.sample(words, 3000)), (5, base[:70]), (6, base[:50]), (7, base[:44]), (8, base[:41] + words[:3])]
    return [(i, " ".join(w)) for i, w in rows]


def test_long_records(spark):
    """Records of thousands of words have as many entries as words, and meet shorter ones across the border of schemes."""
    rows = long_records()
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if jaccard(sets[a], sets[b]) >= S}
    assert {tuple(r) for r in near.near_pairs(df, "id", "t").collect()} == want and {(1, 2), (5, 6), (6, 7)} <= want
    labelled = df.withColumn("split", F.lit("val"))
    got = {(r.held_id, r.train_id) for r in cross.overlaps(labelled, df, "id", "t", ("split",)).collect()}
    assert got == want | {(b, a) for a, b in want} | {(i, i) for i in sets}
    classes = vectors.classes_of(vectors.members(df, "id", "t", 8))[1]
    order = vectors.Order(*vectors.frequent(classes))
    entries = classes.mapInArrow(lambda b: near._entries(b, order, S, near.LONG), "key bigint, c bigint, n int, f bigint, stored boolean").groupBy("c", "n").count().collect()
    assert all(r["count"] < 0.7 * r.n for r in entries if r.n > 2 * near.LONG) and max(r["count"] for r in entries if r.n <= near.LONG) < 600


def test_overlap_classes(spark):
    rows = variants(3, 120)
    held, train = rows[:40], rows[35:]
    h = spark.createDataFrame([(i, t, "val" if i % 2 else "test") for i, t in [*held, held[0]]] + [(900, None, "val"), (901, None, "val")], "id long, t string, split string")
    t = spark.createDataFrame([*train, train[0], (900, "x"), (2000, held[3][1]), (2001, held[3][1])], "id long, t string")
    pairs = {(r.split, r.held_id, r.train_id) for r in cross.overlaps(h, t, "id", "t", ("split",)).collect()}
    got = cross.overlap_classes(h, t, "id", "t", ("split",)).collect()
    assert {(r.split, r.held_id): r.n_links for r in got} == {k: sum(p[:2] == k for p in pairs) for k in {p[:2] for p in pairs}}
    assert len(got) == len({(r.split, r.held_id) for r in got}) and all(r.class_id <= r.held_id for r in got)
    assert cross.overlap_classes(h.limit(0), t, "id", "t", ("split",)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), min_size=1, max_size=30), st.sets(st.integers(-(2**62), 2**62), min_size=1, max_size=30))
def test_fingerprint_distance(a, b):
    import numpy as np

    f = vectors.fingerprints(np.array(sorted(a) + sorted(b), np.int64), np.array([0, len(a), len(a) + len(b)]))
    assert bin((int(f[0]) ^ int(f[1])) & (2**64 - 1)).count("1") <= len(a ^ b)


def test_words(spark):
    t = "Ok خانه‌ها، خَانه_ها ok 12"
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(vectors.words(F.col("t"))).collect()
    assert sorted(got[0][0]) == sorted(set(forms.words(t))) and got[1][0] is None and got[2][0] == []


def test_whole_tables(spark, sf):
    rows = {r.id: set(forms.words(r.cleaned_text)) for r in spark.read.parquet(f"{sf}/train_clips.parquet").collect() if r.cleaned_text}
    long = [i for i in rows if len(rows[i]) >= 8]
    want = {(min(a, b), max(a, b)) for a, b in combinations(long, 2) if jaccard(rows[a], rows[b]) >= S}
    assert {tuple(r) for r in near.p4_found(spark, sf).collect()} == want
