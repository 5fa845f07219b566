import random

import corpus_pipeline as pipeline
from codeloom.llm.shared import stage
from helpers import ODD, docs
from test_minhash import brute
from test_native import base_spans

COLUMNS = list(pipeline.COLUMNS)


def tables(spark, tmp_path, rows, labels):
    docs(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def corpus():
    r = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        text = [r.choice("abcdefghi") + r.choice("lmnop") + r.choice("xyzw") + r.choice("qrst") for _ in range(r.randint(20, 60))]
        if i % 4 == 0:
            text[3] = "scoundrel"
        if i % 7 == 0:
            text[5] = f"u{i}@mail.example.com"
        rows.append((i, " ".join(text), "en", "ab"[i % 2]))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "a") for i in (1, 2, 3)]
    rows += [(2000 + (i or 0), t, "en", "c") for i, t in ODD]
    return rows, labels


def test_stages_in_turn(spark, tmp_path):
    rows, labels = corpus()
    d = tables(spark, tmp_path, rows, labels)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "pii", "mix", "packing"]
    step = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, function in pipeline.STAGES:
        step = stage(function(spark, step, d), name)
        seen[name] = step
        if name != "packing":
            assert step.columns == COLUMNS
    toxic = {i for i, _, t in labels if t}
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert len(kept & toxic) <= 3 and len(kept) >= len({r[0] for r in rows}) - len(toxic) - 3
    before = [(r.doc_id, r.text) for r in seen["toxicity"].collect()]
    roots = brute(before)
    after = [r.doc_id for r in seen["near_dedup"].collect()]
    assert set(after) == {i for i, root in roots.items() if i == root}
    clean = seen["pii"].collect()
    assert sorted(r.doc_id for r in clean) == sorted(after) and not any(base_spans(r.text) for r in clean)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)
    assert sorted(map(tuple, seen["mix"].collect())) == sorted(map(tuple, clean)) if all(r.text is not None for r in clean) else seen["mix"].count() == len(clean)
    assert {r.doc_id for r in step.collect()} == set(after)


def test_empty_documents(spark, tmp_path):
    d = tables(spark, tmp_path, [], [])
    assert pipeline.run(spark, d).count() == 0
