import pytest

from starling.operators import search as S

ITEMS = [(1, "The Matrix", ["Action", "Sci-Fi"], ["cyberpunk"], 90.0), (2, "Matilda", ["Comedy"], ["fun"], 50.0), (3, "Toy Story", ["Comedy"], ["pixar", "fun"], 80.0), (4, "Toy Story 2", ["Comedy"], ["pixar"], 70.0), (5, "Story of Us", ["Drama"], [], 40.0)]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, title string, genres array<string>, tags array<string>, comprehensive_score double")


def ids(df):
    return [r.item_id for r in df.collect()]


def test_linear(items):
    assert sorted(ids(S.linear_search(items, "title", "STORY"))) == [3, 4, 5]
    assert ids(S.linear_search(items, "genre", "sci")) == [1]
    with pytest.raises(ValueError):
        S.linear_search(items, "actor", "x")


def test_the_first_stage_that_finds_anything_answers(items):
    for query, want, stage in (("toy story", [3], "title_phrase"), ("story toy", [3, 4], "token"), ("atil", [2], "substring"), ("the matrx", [1], "fuzzy_token")):
        got = S.indexed_search(items, "title", query).collect()
        assert [r.item_id for r in got] == want and {r.stage for r in got} == {stage}, query
    assert ids(S.indexed_search(items, "title", "zzzz qqqq")) == []


def test_genres_and_tags(items):
    assert ids(S.indexed_search(items, "genre", "comedy")) == [3, 4, 2]
    assert ids(S.indexed_search(items, "genre", "comdy")) == [3, 4, 2]
    assert ids(S.indexed_search(items, "tag", "Pixar")) == [3, 4]
    with pytest.raises(ValueError):
        S.indexed_search(items.drop("tags"), "tag", "pixar")


def test_similar(items):
    got = S.similar_items(items, 3, 5).collect()
    assert [r.item_id for r in got] == [4, 2] and got[0].is_series and not got[1].is_series


def slow_fuzzy(keys, q, least):
    """Every key's mean of bigram Jaccard and ratio, by the standard library."""
    from difflib import SequenceMatcher

    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    out = {}
    for k in keys:
        ratio = SequenceMatcher(None, q, k).ratio()
        a, b = grams(q), grams(k)
        mean = ((len(a & b) / len(a | b) if a | b else 0.0) + ratio) / 2
        if (len(q) < 3 or a & b) and (mean >= least or ratio >= least):
            out[k] = round(mean, 6)
    return out


def test_fuzzy_keys_equal_brute_force(spark):
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcde ", k=rng.randint(3, 14))).strip() or "ab"
    keys = sorted({word() for _ in range(250)})
    frame = spark.createDataFrame([("title", k) for k in keys], "field string, key string").persist()
    for q in [word() for _ in range(6)] + keys[:3]:
        got = {r.key: r.similarity for r in S.fuzzy_keys(frame, q, 0.6).collect()}
        want = slow_fuzzy(keys, q, 0.6)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got), q
