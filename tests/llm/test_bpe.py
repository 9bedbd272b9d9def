import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from starling.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.tokenizer_path())
PARTS = ["a", "b", "aa", " ", "\n", "é", "日本", "1", "!", "the", "ing", "'s", "<|endoftext|>", "zz", "😀", "՘", "₏", "\x85", "\xa0", "\x1c", "\t\t", "'LL"]
TEXTS = [None, "", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b", "Hello world's end", "aaaa" * 5000, "ab" * 3000, " " * 9000, "é" * 999]


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(open(bpe.tokenizer_path(), "rb").read())


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_equals_the_library(model):
    rng = random.Random(6)
    for text in [t for t in TEXTS if t is not None] + ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(3000)]:
        ids, back = want(text)
        got = model.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert model.decode(got).decode() == back == text


def test_unsure_characters_take_the_library_s_split(model):
    """Every character whose class differs between Unicode versions is left to the library."""
    from tokenizers.pre_tokenizers import ByteLevel

    own = ByteLevel(add_prefix_space=False, use_regex=True)
    for point in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(point)
        if not model.unsure.search(c):
            text = f"a{c}1{c}"
            assert [m.span() for m in model.find.finditer(text)] == [s for _, s in own.pre_tokenize_str(text)], hex(point)


def test_long_texts_are_taken_in_blocks(model, monkeypatch):
    text = "Some words, and numbers 123; " * 50
    whole = model.encode(text)
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    assert model.encode(text) == whole and model.decode(whole).decode() == text


def test_frames(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (1, "again", "x", 1), (1, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(map(tuple, bpe.digests(docs).collect()), key=str)
    expected = []
    for i, t, *_ in rows:
        ids, back = want(t)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.filter("doc_id <> 1"))).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows if i not in (None, 1))
    assert bpe.digests(docs.limit(0)).count() == 0


def test_incomplete_and_other_vocabularies_are_refused():
    spec = json.loads(bpe._blob(None))
    gone = {k: v for k, v in spec["model"]["vocab"].items() if k != "a"}
    for change in ({"vocab": gone, "merges": []}, {"dropout": 0.1}, {"byte_fallback": True}, {"end_of_word_suffix": "</w>"}, {"type": "Unigram"}):
        with pytest.raises(ValueError):
            bpe.Bpe(json.dumps(spec | {"model": spec["model"] | change}).encode())


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(["ab cd", None, "é"])], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in bpe.op6_bpe(spark, str(tmp_path)).collect()}
    assert got == {i: len(want(t)[0]) for i, t in enumerate(["ab cd", None, "é"])}
