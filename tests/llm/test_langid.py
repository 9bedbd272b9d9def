import random
import zlib

import numpy as np
import pytest

from starling.llm import langid as L

WORDS = {"xx": ["ther", "and", "ing", "wh", "th"], "yy": ["sch", "ung", "keit", "ver", "zu"], "zz": ["eau", "oi", "que", "é", "ç"]}


def text(lang, rng, n=60):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("languages", [1, 10, 70, 200])
def test_filter_holds_all_members_and_few_others(languages):
    rng, settings = np.random.default_rng(1), L.Settings()
    members = [rng.integers(0, 2**63, 3000 - 10 * i).astype(np.uint64) for i in range(languages)]
    f = L.LanguageFilter([f"l{i}" for i in range(languages)], members, settings)
    bits = lambda masks: np.unpackbits(masks, axis=1, bitorder="little")
    for bit, hashes in enumerate(members):
        assert bits(f.masks(hashes))[:, bit].all()
    others = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert (abs(bits(f.masks(others))[:, :languages].mean(axis=0) - f.false) < 0.004).all()
    assert (f._popcounts(f.masks(others)) == bits(f.masks(others))[:, :languages].sum(axis=0)).all()


def test_prediction_equals_exact_sets():
    """Shares after the correction are near those of exact n-gram sets, and the languages the same."""
    rng, orders = random.Random(9), (2, 3, 4)
    gram = lambda t: np.concatenate(list(L.grams(t, orders)))
    languages = [f"l{i}" for i in range(70)]
    letters = {lang: rng.sample("abcdefghijklmnopqrstuvwxyzéèüöäß", 9) for lang in languages}
    made = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 7))) for _ in range(n))
    sets = {lang: set(gram(made(lang, 400)).tolist()) for lang in languages}
    f = L.LanguageFilter(languages, [np.array(sorted(sets[lang]), dtype=np.uint64) for lang in languages], L.Settings())
    for lang in languages:
        text = made(lang, 60)
        shares = {x: sum(g in sets[x] for g in gram(text).tolist()) / len(gram(text)) for x in languages}
        best = max(languages, key=lambda x: shares[x])
        assert f.predict(text)[0] == best
        assert abs(f.predict(text)[1] - shares[best]) < 0.01


def test_blocks_give_the_same_grams(monkeypatch):
    words = text("xx", random.Random(2), 400)
    whole = np.sort(np.concatenate(list(L.grams(words, (2, 3, 4)))))
    monkeypatch.setattr(L, "BLOCK", 17)
    assert (np.sort(np.concatenate(list(L.grams(words, (2, 3, 4))))) == whole).all()


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, rng), lang, "s", 1.0) for i, lang in enumerate(rng.choices(list(WORDS), k=400))]
    odd = [(1000, None, "xx", "s", 1.0), (1001, "", "yy", "s", 1.0), (1002, "123 !?", "zz", "s", 1.0), (None, rows[0][1], "xx", "s", 1.0), (1003, "keitung " * 90000, None, "s", 1.0), (5, rows[5][1], rows[5][2], "s", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    got = L.identify(docs, L.fit(docs.filter(~L.held_out()))).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert all(by[i].lang_pred == lang for i, _, lang, *_ in rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "yy" and by[None].lang_pred == rows[0][2] and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert [r.lang_pred for r in L.identify(docs, model).collect()] == ["und"]
    assert L.identify(docs.limit(0), model).count() == 0


def test_more_languages_than_a_word_has_bits_and_a_bounded_sample(spark):
    words = {f"l{i:02}": ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(1)] for i in range(80)}
    rows = [(i, " ".join(words[f"l{i % 80:02}"] * 12), f"l{i % 80:02}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, L.Settings(sample_docs=4))
    assert len(model.languages) == 80
    assert all(r.lang_pred == rows[r.doc_id][2] for r in L.identify(docs, model).collect())


def test_sample_has_its_size(spark):
    """Each row has a word of its own, so the n-grams tell how many rows were taken."""
    rows = [(i, chr(0x4E00 + i) * 2, "zz") for i in range(4000)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), L.Settings(orders=(2,), sample_docs=500))
    taken = sum(bool(model.masks(np.concatenate(list(L.grams(t, (2,))))[1:2]).any()) for _, t, _ in rows)
    assert 400 < taken < 620


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, text(lang, rng), lang, "s", 1) for i, lang in enumerate(rng.choices(list(WORDS), k=120))] + [(500, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op8_langid(spark, str(tmp_path)).collect()
    assert len(got) == 121 and all(r.lang_pred == (rows[r.doc_id][2] if r.doc_id < 500 else "und") for r in got)
