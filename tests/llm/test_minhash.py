import collections
import random

import numpy as np

from codeloom.llm import components as stars, minhash
from codeloom.llm.components import components, few_components
from codeloom.llm.minhash import BANDS, ROWS, near_duplicates, sketch
from codeloom.llm.words import series, shingles, hashed_words
from helpers import ODD, docs, shingle_set

import pyarrow as pa


def brute(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingle_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(8, 120))]
        for _ in range(r.randint(1, 14)):
            text = [w if r.random() > 0.01 else r.choice(vocabulary) for w in base]
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def check(spark, rows, extra=False):
    out = near_duplicates(docs(spark, rows, extra)).collect()
    assert len(out) == len(rows)
    expected = brute(rows)
    sizes = collections.Counter((i, len(shingle_set(t))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in out) == sizes
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_agrees_with_brute_force(spark):
    check(spark, corpus())


def test_odd_rows(spark):
    check(spark, ODD, extra=True)


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).count() == 0


def test_two_texts_of_one_id_tie_their_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    out = near_duplicates(docs(spark, [(5, a), (7, a), (7, b), (9, b)])).collect()
    assert {r.component_id for r in out} == {5}


def test_all_members_of_a_crowded_bucket_are_compared(spark):
    # A chain in which each text is similar to its neighbours only; all share their head.
    base = [f"h{i}" for i in range(100)]
    rows = [(k, " ".join(base[k * 4 : k * 4 + 60])) for k in range(10)]
    check(spark, rows)


def test_every_coordinate_fills_and_estimates_similarity():
    t = BANDS * ROWS
    common, own = series(1, 150), series(2, 50)
    other = series(3, 50)
    sets = [np.sort(np.concatenate((common, own))), np.sort(np.concatenate((common, other))), series(4, 1), np.zeros(0, np.uint64)]
    ends = np.cumsum([0] + [len(s) for s in sets])
    rows = sketch(np.concatenate(sets), ends)
    assert (rows[:3] != ~np.uint64(0)).all() and (rows[3] == ~np.uint64(0)).all()
    assert abs((rows[0] == rows[1]).mean() - 0.6) < 0.15
    assert rows.shape == (4, t)


def test_long_text_is_cut_at_blanks_only():
    text = "ab cde " * 400_000
    (_, hashes, offsets), = hashed_words(pa.array([text]))
    assert len(hashes) == 800_000 and len(set(hashes.tolist())) == 2
    assert len(shingles(hashes, offsets)[0]) == 2


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as u", "id - 1 as v")
    out = components(edges).collect()
    assert len(out) == 300 and {r.root for r in out} == {0}


def test_components_of_nothing(spark):
    assert components(spark.range(0).selectExpr("id as u", "id as v")).count() == 0


def test_few_tables_are_staged(spark, monkeypatch):
    # Each is a pass over all partitions, which cost more than the work itself where those are many.
    labels = []

    def counting(df, label, put=minhash.stage):
        labels.append(label)
        return put(df, label)

    for module in (minhash, stars):
        monkeypatch.setattr(module, "stage", counting)
    check(spark, corpus())
    assert len(labels) <= 30, labels


def test_many_links_take_rounds_of_shuffles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 0)
    check(spark, corpus())


def test_few_components_are_those_of_shuffles(spark):
    r = random.Random(5)
    links = [(r.randint(-60, 60), r.randint(-60, 60)) for _ in range(70)] + [(99, 99), (None, 7), (8, None)]
    edges = spark.createDataFrame(links, "u long, v long")
    few = {(x.node, x.root) for x in few_components(edges).collect()}
    assert few == {(x.node, x.root) for x in components(edges).collect()}
    assert few_components(edges.limit(0)).count() == 0
