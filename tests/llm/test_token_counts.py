import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from starling.llm import token_counts as T


def library(pieces, scores, fallback):
    pieces, scores = (pieces + BYTES, scores + [min(scores)] * 256) if fallback else (pieces, scores)
    t = Tokenizer(models.Unigram(list(zip(pieces, scores)), pieces.index("<unk>"), fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.SPACE, prepend_scheme="always", split=True)
    return t


BYTES = [f"<0x{b:02X}>" for b in range(256)]
TIES = ["<unk>", T.SPACE, "a", "b", "c", "ab", "bc", "abc", T.SPACE + "a", "aa", "aaa", "bb", "cab"], [0.0, -2.0, -1.0, -1.0, -1.0, -2.0, -2.0, -3.0, -3.0, -2.0, -3.0, -2.0, -3.0]


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknown_characters(fallback):
    pieces, scores = TIES
    counter, t, rng = T.UnigramCounter(pieces, scores, fallback), library(pieces, scores, fallback), random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(["a", "b", "c", " ", "é", "😀", "x", T.SPACE, "\n"], k=rng.randint(0, 14)))
        assert counter.text(text) == len(t.encode(text).ids), text


def test_public_vocabulary(spark):
    pieces, scores, bytes_ = T.vocabulary()
    assert bytes_ and not {"<s>", "</s>", "<unk>", "<0x41>"} & set(pieces)
    t = library(["<unk>", *pieces], [min(scores), *scores], True)
    texts = [None, "", " ", "Hello world", " leading", "tabs\tand\n\nlines", "日本語 und Größe", "the the the " * 3000, "x" * 20000]
    docs = spark.createDataFrame([(i, s, 7) for i, s in enumerate(texts)] + [(None, "null id", 7)] * 2, "doc_id long, text string, n_tokens int")
    got = T.token_counts(docs, pieces, scores, bytes_).collect()
    assert len(got) == len(texts) + 2
    assert all(r.n_tokens == len(t.encode(texts[r.doc_id] or "").ids) for r in got if r.doc_id is not None)
    assert T.token_counts(docs.limit(0), pieces, scores).count() == 0


def test_control_pieces_match_no_text():
    counter = T.UnigramCounter(*T.vocabulary())
    plain = T.UnigramCounter(["<", "/", "s", ">", "a", "b", "c", T.SPACE], [-1.0] * 8)
    assert counter.text("abc</s>") > 3 and counter.text("<s>") >= 3 and counter.text("<0x41>") > 2
    assert plain.text("abc</s>") == 8


def test_query(spark, tmp_path):
    texts = ["a few words", "", None, "</s> " * 50]
    spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    counter = T.UnigramCounter(*T.vocabulary())
    assert {r.doc_id: r.n_tokens for r in T.op7_token_counts(spark, str(tmp_path)).collect()} == {i: counter.text(t) for i, t in enumerate(texts)}


def test_long_texts_are_taken_in_blocks(monkeypatch):
    pieces, scores = TIES
    text = "abc ab  cab é " * 40
    whole = T.UnigramCounter(pieces, scores).text(text)
    monkeypatch.setattr(T, "LONG", 10)
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "REMEMBERED", 15)
    assert T.UnigramCounter(pieces, scores).text(text) == whole
