import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from starling.llm import bpe, secret_scan
from tests.llm.test_decontaminate import slow as contaminated
from tests.llm.test_near_copies import slow as near_copies


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    w = lambda n: " ".join("".join(rng.choices(["ta", "ro", "mi", "ke", "lu"], k=rng.randint(2, 4))) for _ in range(n))
    items = [(i, w(30)) for i in range(3)]
    good = [w(rng.randint(60, 90)) for _ in range(60)]
    texts = good + good[:5] + [t + " end" for t in good[5:8]] + [items[0][1] + " " + w(60), w(40) + " " + items[1][1], w(70) + " token = 'abcdefgh12345678'"]
    texts += [" ".join(f"{x}###" for x in t.split()) for t in good[20:32]] + ["short", "", None, "same line\n" * 60]
    docs = [(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)] + [(0, good[0], "en", "s", 5, "extra"), (None, w(80), None, None, None, None)]
    labels = [(i, int(i < 71), 0) for i in range(0, len(texts), 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, __text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_each_stage_and_the_whole(spark, folder):
    d, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5
    kept = stage["quality_rules"](spark, docs, d).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(71, 87)) and len(ids) > 55
    single = stage["near_dedup"](spark, kept, d).cache()
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (r[0] is None, r[0]))
    root = near_copies([t for _, t in rows])
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted({rows[k][0] for k in root} - {None})
    assert len(set(root)) < len(rows)
    clean = stage["decontamination"](spark, single, d).cache()
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in single.collect()], items) if r[5]}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in single.collect() if r.doc_id not in bad) and bad
    safe = stage["secret_scans"](spark, clean, d).cache()
    assert safe.columns == docs.columns and safe.count() == clean.count()
    assert not any(secret_scan.base_spans(r.text) for r in safe.collect()) and any("[SECRET]" in r.text for r in safe.collect())
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for r in safe.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str) == sorted(want, key=str)


def test_empty_documents(spark, folder, tmp_path):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0
