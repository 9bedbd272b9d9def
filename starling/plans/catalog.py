"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import rank_percentile, top, year_affinity
from ..functions.text import bigrams, jaccard, normalise, series_key
from ..operators import aliases, candidates, collaborative as cf, evaluation as ev, factors, recall, rerank, scoring, search, selection, sessions, vectors
from ..sources import domain

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The domain as SQL sees it.
RAW = """raw AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating, l_shipdate AS ts, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = f"""{RAW}, ratings AS (SELECT user_id, item_id, rating, ts FROM raw
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC) = 1)"""
ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS title, [p_brand, p_type] AS genres, 1950 + p_size AS release_year FROM part)"
TAGS = "tags AS (SELECT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS tag FROM part)"
EVENTS = """events_ AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' WHEN 'signup' THEN 'reset' ELSE 'view' END AS event_type,
  ts, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events)"""
CENTRED = "centred AS (SELECT * FROM (SELECT user_id, item_id, rating, rating - avg(rating) OVER (PARTITION BY user_id) AS c, sqrt(var_pop(rating) OVER (PARTITION BY user_id) * count(*) OVER (PARTITION BY user_id)) AS norm FROM ratings) WHERE norm > 1e-9)"
SPLIT = """split AS (SELECT user_id, item_id, rating, ts, CASE WHEN rn <= greatest(n - greatest(CAST(round_even(n * 0.2, 0) AS BIGINT), 1), 1) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ratings) WHERE n >= 12)"""
QUALITY = """quality AS (SELECT item_id, 0.75 * ((n * mean + 25 * (SELECT avg(rating) FROM split WHERE split = 'train')) / (n + 25)) / 5 + 0.25 * ln(1 + n) / ln(1 + max(n) OVER ()) AS quality
  FROM (SELECT item_id, count(*) AS n, avg(rating) AS mean FROM split WHERE split = 'train' GROUP BY item_id))"""


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def four(c, name: str):
    return F.round(c, 4).alias(name)


# Scores.

SCORES = f"""WITH {RAW}, {ITEMS},
  stats AS (SELECT item_id, count(*) AS n, avg(rating) AS mean FROM raw GROUP BY item_id),
  users AS (SELECT user_id, avg(rating) AS mean FROM raw GROUP BY user_id),
  k AS (SELECT avg(rating) AS mu, min(rating) AS low, max(rating) AS high, max(ts) AS last_ts FROM raw),
  pref AS (SELECT item_id, avg(least(greatest(rating - users.mean + mu, low), high)) AS adj FROM raw JOIN users USING (user_id), k GROUP BY item_id),
  recent AS (SELECT item_id, count(*) AS r FROM raw, k WHERE ts >= last_ts - INTERVAL 180 DAY GROUP BY item_id),
  base AS (SELECT item_id, title, release_year, n, mean, adj, coalesce(r, 0) AS r, mu, max(n) OVER () AS most, max(coalesce(r, 0)) OVER () AS most_recent
    FROM items JOIN stats USING (item_id) JOIN pref USING (item_id) LEFT JOIN recent USING (item_id), k),
  b AS (SELECT *, (n * mean + 563.0 * mu) / (n + 563.0) AS plain, (n * adj + 563.0 * mu) / (n + 563.0) AS moved,
    ln(1 + n) / ln(1 + most) * 25.0 AS popular, CASE WHEN most_recent > 0 THEN ln(1 + r) / ln(1 + most_recent) * 5.0 ELSE 0.0 END AS fresh FROM base)
"""
SCORE_COLUMNS = """item_id, title, CAST(n AS BIGINT) AS rating_count, CAST(r AS BIGINT) AS recent_rating_count, round(plain, 4) AS bayesian_rating, round(moved, 4) AS preference_adjusted_bayesian_rating,
  round(popular, 4) AS popularity_score, round(fresh, 4) AS freshness_score, round(plain * 14 + popular + fresh, 4) AS comprehensive_score, round(moved * 14 + popular + fresh, 4) AS preference_adjusted_comprehensive_score"""
SHOWN = ["item_id", "title", "rating_count", "recent_rating_count", "bayesian_rating", "preference_adjusted_bayesian_rating", "popularity_score", "freshness_score", "comprehensive_score", "preference_adjusted_comprehensive_score"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.item_scores(domain.items(spark, d), domain.raw_ratings(spark, d)).select(*SHOWN)


@query(f"{SCORES} SELECT {SCORE_COLUMNS} FROM b")
def item_scores(spark, d):
    return _scores(spark, d)


@query(f"{SCORES} SELECT {SCORE_COLUMNS} FROM b ORDER BY comprehensive_score DESC, rating_count DESC, item_id LIMIT 20")
def top_scores(spark, d):
    return scoring.leaderboard(_scores(spark, d), 20)


@query(f"{SCORES} SELECT {SCORE_COLUMNS} FROM b ORDER BY preference_adjusted_comprehensive_score DESC, rating_count DESC, item_id LIMIT 20")
def top_scores_preference(spark, d):
    return scoring.leaderboard(_scores(spark, d), 20, "preference_adjusted", "merge")


@query(f"WITH {RAW} SELECT item_id, count(*) AS rating_count, round(avg(rating), 4) AS rating_avg FROM raw GROUP BY item_id")
def item_stats(spark, d):
    return scoring.item_stats(domain.raw_ratings(spark, d)).select("item_id", "rating_count", four(F.col("rating_avg"), "rating_avg"))


@query(f"WITH {RAW} SELECT user_id, count(*) AS rating_count, round(avg(rating), 4) AS rating_avg, round(sqrt(var_pop(rating) * count(*)), 4) AS rating_norm FROM raw GROUP BY user_id")
def user_stats_norms(spark, d):
    return scoring.user_stats(domain.raw_ratings(spark, d)).select("user_id", "rating_count", four(F.col("rating_avg"), "rating_avg"), four(F.col("rating_norm"), "rating_norm"))


@query(f"{SCORES} SELECT item_id, round(adj, 4) AS preference_adjusted_rating FROM pref")
def preference_adjusted(spark, d):
    return scoring.preference_adjusted(domain.raw_ratings(spark, d)).select("item_id", four(F.col("preference_adjusted_rating"), "preference_adjusted_rating"))


@query(f"{SCORES} SELECT item_id, r AS recent_rating_count FROM recent")
def recent_counts(spark, d):
    return scoring.recent_counts(domain.raw_ratings(spark, d))


@query(f"WITH {RAW} SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(ts) AS first_ts, max(ts) AS last_ts FROM raw")
def import_summary(spark, d):
    return domain.raw_ratings(spark, d).agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Tags, profiles and search.

TAG_WEIGHT = "round(ln(1 + n) * round(0.52 + 0.48 * least(ln(1 + n) / ln(6), 1.0), 4) * 1.18, 4)"


@query(f"WITH {TAGS}, c AS (SELECT item_id, lower(tag) AS tag, count(*) AS n FROM tags GROUP BY ALL) SELECT item_id, tag, n AS count, 'theme' AS facet, round(0.52 + 0.48 * least(ln(1 + n) / ln(6), 1.0), 4) AS confidence, {TAG_WEIGHT} AS weight FROM c")
def tag_details(spark, d):
    return scoring.tag_details(domain.tags(spark, d)).select("item_id", "tag", "count", "facet", "confidence", "weight")


PROFILES = f"""{SCORES[:-1]}, {TAGS}, evidence AS (SELECT item_id, sum({TAG_WEIGHT}) AS e FROM (SELECT item_id, tag, count(*) AS n FROM tags GROUP BY ALL) GROUP BY item_id),
  p AS (SELECT item_id, coalesce(s.n, 0) AS n, coalesce(s.mean, 0) AS mean, coalesce(pref.adj, 0) AS adj, coalesce(recent.r, 0) AS r, coalesce(e, 0) AS e, k.mu FROM items LEFT JOIN stats s USING (item_id) LEFT JOIN pref USING (item_id) LEFT JOIN recent USING (item_id) LEFT JOIN evidence USING (item_id), k),
  q AS (SELECT *, CASE WHEN n > 0 THEN (n * mean + 25 * mu) / (n + 25) ELSE 0 END AS plain, ln(1 + n) / ln(1 + max(n) OVER ()) * 20 AS popular, ln(1 + e) / ln(1 + greatest(max(e) OVER (), 1)) * 5 AS tagged, CASE WHEN max(r) OVER () > 0 THEN ln(1 + r) / ln(1 + max(r) OVER ()) * 5 ELSE 0 END AS fresh FROM p)
  """


@query(f"{PROFILES} SELECT item_id, CAST(n AS BIGINT) AS rating_count, round(e, 4) AS tag_evidence, round(plain, 4) AS bayesian_rating, round(popular, 4) AS popularity_score, round(tagged, 4) AS tag_score, round(fresh, 4) AS freshness_score, round(plain * 14 + popular + tagged + fresh, 4) AS comprehensive_score FROM q")
def profile_join_left(spark, d):
    return _profiles(spark, d).select("item_id", "rating_count", "tag_evidence", "bayesian_rating", "popularity_score", "tag_score", "freshness_score", "comprehensive_score")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return scoring.item_profiles(domain.items(spark, d), domain.raw_ratings(spark, d), domain.tags(spark, d))


@query(f"WITH {ITEMS} SELECT item_id, title FROM items WHERE list_contains(list_transform(genres, lambda g: lower(g)), 'brand#11')")
def genre_search(spark, d):
    found = search.postings(domain.items(spark, d)).filter((F.col("field") == "genre") & (F.col("key") == "brand#11"))
    return found.select("item_id").join(domain.items(spark, d).select("item_id", "title"), "item_id")


@query(f"WITH {ITEMS} SELECT item_id, title FROM items WHERE contains(lower(title), 'in')")
def title_substring(spark, d):
    return search.linear_search(domain.items(spark, d), "title", "In").select("item_id", "title")


@query(f"WITH {ITEMS}, w AS (SELECT min(title) AS t FROM items) SELECT item_id, CAST(1 AS DOUBLE) AS similarity FROM items, w WHERE list_has_all(string_split(lower(title), ' '), string_split(lower(t), ' '))")
def title_token_search(spark, d):
    items = domain.items(spark, d)
    return search.token_search(search.postings(items), "title", items.agg(F.min("title")).first()[0]).select("item_id", F.col("similarity").cast("double").alias("similarity"))


@query("""WITH t AS (SELECT DISTINCT lower(p_name) AS title FROM part), g AS (SELECT title, list_distinct(list_transform(range(1, greatest(length(title), 2)), lambda i: substr(title, i, 2))) AS grams FROM t), f AS (SELECT * FROM g ORDER BY title LIMIT 1)
  SELECT g.title AS title, round(len(list_intersect(g.grams, f.grams)) / len(list_distinct(list_concat(g.grams, f.grams))), 6) AS similarity FROM g, f""")
def ngram_jaccard(spark, d):
    titles = domain.items(spark, d).select(normalise(F.col("title")).alias("title")).distinct().select("title", bigrams(F.col("title")).alias("grams"))
    first = titles.orderBy("title").limit(1).select(F.col("grams").alias("other"))
    return titles.crossJoin(F.broadcast(first)).select("title", F.round(jaccard(F.col("grams"), F.col("other")), 6).alias("similarity"))


@query()
def fuzzy_title(spark, d):
    """Titles near the least title without its second letter."""
    items = domain.items(spark, d)
    name = items.agg(F.min("title")).first()[0]
    return search.indexed_search(items.withColumn("comprehensive_score", F.lit(0.0)), "title", name[:1] + name[2:]).select("item_id", "title", "stage", "similarity")


@query("""SELECT series, count(*) AS items FROM (SELECT regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '( (part|pt|episode|ep|volume|vol|chapter|[0-9]+))+$', '') AS series FROM part) GROUP BY series""")
def series_groups(spark, d):
    return domain.items(spark, d).select(series_key(F.col("title")).alias("series")).groupBy("series").agg(F.count(F.lit(1)).alias("items"))


@query(f"WITH {ITEMS}, t AS (SELECT min(item_id) AS id FROM items), a AS (SELECT item_id AS aid, genres AS ag, string_split(title, ' ') AS words FROM items, t WHERE item_id = id) SELECT item_id, CAST(len(list_intersect(genres, ag)) AS BIGINT) AS shared_genres, CAST(len(list_intersect(string_split(title, ' '), words)) AS BIGINT) AS shared_tags FROM items, a WHERE item_id <> aid AND (len(list_intersect(genres, ag)) > 0 OR len(list_intersect(string_split(title, ' '), words)) > 0)")
def similar_items_overlap(spark, d):
    items = domain.items(spark, d).withColumn("tags", F.split("title", " "))
    one = items.orderBy("item_id").limit(1).select(F.col("item_id").alias("own"), F.col("genres").alias("g"), F.col("tags").alias("t"))
    both = items.crossJoin(F.broadcast(one)).filter("item_id <> own")
    both = both.select("item_id", F.size(F.array_intersect("genres", "g")).cast("long").alias("shared_genres"), F.size(F.array_intersect("tags", "t")).cast("long").alias("shared_tags"))
    return both.filter("shared_genres > 0 or shared_tags > 0")


@query()
def similar_items(spark, d):
    profiles = _profiles(spark, d)
    return search.similar_items(profiles, 1, 20)


@query(f"WITH {TAGS}, c AS (SELECT DISTINCT item_id, tag FROM tags) SELECT x.tag AS a, y.tag AS b, count(*) AS overlap FROM c x JOIN c y ON x.item_id = y.item_id AND x.tag < y.tag GROUP BY ALL HAVING count(*) >= 2")
def tag_cooccurrence(spark, d):
    return vectors.tag_cooccurrence(domain.tags(spark, d))


@query(f"WITH {TAGS} SELECT tag, count(DISTINCT item_id) AS df, round(least(ln(((SELECT count(DISTINCT item_id) FROM tags) + 1) / (count(DISTINCT item_id) + 1)) + 1, 4.2), 6) AS idf FROM tags GROUP BY tag")
def tag_idf(spark, d):
    return vectors.tag_idf(domain.tags(spark, d)).select("tag", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {TAGS}, {ITEMS}, f AS (SELECT item_id, 'genre:' || lower(unnest(genres)) AS feature, 2.6 / sqrt(2) AS value FROM items UNION ALL SELECT item_id, 'tag:' || tag, count(*) FROM tags GROUP BY ALL),
  u AS (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS v FROM f), q AS (SELECT feature, v FROM u WHERE item_id = (SELECT min(item_id) FROM items))
  SELECT item_id, round(sum(u.v * q.v), 6) AS cosine FROM u JOIN q USING (feature) WHERE item_id <> (SELECT min(item_id) FROM items) GROUP BY item_id""")
def content_cosine(spark, d):
    items = domain.items(spark, d)
    genres = items.select("item_id", F.explode("genres").alias("g")).select("item_id", F.concat(F.lit("genre:"), F.lower("g")).alias("feature"), F.lit(2.6 / 2**0.5).alias("value"))
    tags = domain.tags(spark, d).groupBy("item_id", F.concat(F.lit("tag:"), F.col("tag")).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    every = genres.unionByName(tags)
    first = items.agg(F.min("item_id").alias("item_id"))
    found = vectors.cosine(every, every.join(F.broadcast(first), "item_id").select("feature", "value"), first)
    return found.select("item_id", F.round("cosine", 6).alias("cosine"))


@query()
def content_vectors(spark, d):
    return vectors.content_vectors(_profiles(spark, d)).select("item_id", "feature", F.round("value", 6).alias("value"))


@query("""WITH t AS (SELECT c_custkey AS item_id, n_name AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_custkey, c_mktsegment FROM customer),
  df AS (SELECT tag, count(DISTINCT item_id) AS n FROM t GROUP BY tag HAVING count(DISTINCT item_id) >= 3),
  c AS (SELECT a.tag AS tag, b.tag AS neighbour, round(count(*) / sqrt(any_value(x.n) * any_value(y.n)), 6) AS cosine, count(*) AS shared FROM t a JOIN t b ON a.item_id = b.item_id AND a.tag <> b.tag JOIN df x ON x.tag = a.tag JOIN df y ON y.tag = b.tag GROUP BY ALL)
  SELECT tag, neighbour, round(cosine, 4) AS similarity, shared, row_number() OVER (PARTITION BY tag ORDER BY cosine DESC, neighbour) AS rank FROM c WHERE cosine >= 0.24 QUALIFY rank <= 10""")
def tag_semantics(spark, d):
    """Nations, regions and segments as tags of customers: fewer tags than dimensions, so that the space keeps their cosines."""
    nations = domain.table(spark, d, "nation").join(domain.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = domain.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    tagged = rows.select(F.col("c_custkey").alias("item_id"), F.explode(F.array("n_name", "r_name", "c_mktsegment")).alias("tag"), F.lit(1.0).alias("weight"))
    return vectors.tag_semantics(tagged).withColumn("rank", F.col("rank").cast("long"))


@query()
def alias_report(spark, d):
    """Aliases among the names of parts, each item tagged with its name written in two ways."""
    otherwise = F.concat(F.regexp_replace("title", " ", "-"), F.lit("s"))
    return aliases.alias_report(domain.items(spark, d).select("item_id", F.explode(F.array("title", otherwise)).alias("tag")))


# Collaborative filtering.

NEIGHBOURS = f"""{CENTRED}, dots AS (SELECT x.user_id, y.user_id AS neighbor_id, count(*) AS shared, round(sum(x.c * y.c) / (any_value(x.norm) * any_value(y.norm)) * count(*) / (count(*) + 5.0), 8) AS similarity
    FROM centred x JOIN centred y ON x.item_id = y.item_id AND x.user_id <> y.user_id WHERE x.user_id % 100 = 0 GROUP BY ALL),
  near AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, neighbor_id) AS rank FROM dots WHERE shared >= 2 AND similarity > 0 QUALIFY rank <= 32)"""


@query(f"WITH {RATINGS}, {NEIGHBOURS} SELECT user_id, neighbor_id, round(similarity, 4) AS similarity, shared, CAST(rank AS BIGINT) AS rank FROM near")
def user_neighbors(spark, d):
    """Neighbours of the users whose id is divisible by 100, among all."""
    ratings = domain.ratings(spark, d)
    found = cf.user_neighbors(ratings, ratings.filter("user_id % 100 = 0"))
    return found.select("user_id", "neighbor_id", four(F.col("similarity"), "similarity"), "shared", F.col("rank").cast("long").alias("rank"))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """The ratings of the users that are the stated query set, as sessions."""
    return domain.ratings(spark, d).filter("user_id % 100 = 0").select(F.col("user_id").alias("session_id"), "item_id", "rating")


SESSION_SCORES = """p AS (SELECT user_id AS session_id, item_id, rating - 3.0 AS a, sqrt(sum((rating - 3.0) ** 2) OVER (PARTITION BY user_id)) AS size FROM ratings WHERE user_id % 100 = 0),
  sdots AS (SELECT session_id, user_id, count(*) AS shared, round(sum(a * c) / (any_value(size) * any_value(norm)) * count(*) / (count(*) + 5.0), 8) AS s FROM p JOIN centred USING (item_id) WHERE size > 0 GROUP BY ALL),
  snear AS (SELECT * FROM sdots WHERE shared >= 2 AND s > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY s DESC, user_id) <= {k}),
  scores AS (SELECT session_id, item_id, sum(s * c) / sum(s) AS pref, count(*) AS support, avg(rating) AS mean FROM snear JOIN centred USING (user_id) WHERE rating >= 4 AND c > 0 AND (session_id, item_id) NOT IN (SELECT (user_id, item_id) FROM ratings WHERE user_id % 100 = 0) GROUP BY ALL)"""


@query(f"WITH {RATINGS}, {CENTRED}, {SESSION_SCORES.format(k=32)} SELECT session_id, item_id, support, round(mean, 4) AS average, round(65 * pref + 15 * least(ln(1 + support) / ln(33), 1.0) + 20 * mean / 5, 4) AS score FROM scores")
def cf_candidates(spark, d):
    ratings, own = domain.ratings(spark, d), _profile(spark, d)
    return cf.score_candidates(cf.profile_neighbors(own, ratings, cf.LARGE_SESSION), ratings, own, cf.LARGE_SESSION)


@query(f"WITH {RATINGS}, {CENTRED}, {SESSION_SCORES.format(k=24)} SELECT session_id, item_id, support, round(mean, 4) AS average, round(70 * pref + 18 * least(ln(1 + support) / ln(25), 1.0) + 12 * mean / 5, 4) AS score FROM scores WHERE support >= 2")
def cf_candidates_small(spark, d):
    ratings, own = domain.ratings(spark, d), _profile(spark, d)
    return cf.score_candidates(cf.profile_neighbors(own, ratings, cf.SMALL_SESSION), ratings, own, cf.SMALL_SESSION)


LIKED = "liked AS (SELECT user_id, item_id FROM ratings WHERE rating >= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) <= 40)"


@query(f"""WITH {RATINGS}, {LIKED}, m AS (SELECT item_id, count(*) AS m FROM liked GROUP BY item_id), both_ AS (SELECT x.item_id, y.item_id AS neighbor_id, count(*) AS n FROM liked x JOIN liked y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY ALL HAVING count(*) >= 2),
  s AS (SELECT b.item_id, neighbor_id, n, round(n / sqrt(mx.m * my.m) * n / (n + 10), 8) AS similarity FROM both_ b JOIN m mx ON mx.item_id = b.item_id JOIN m my ON my.item_id = neighbor_id)
  SELECT item_id, neighbor_id, n, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY s.similarity DESC, neighbor_id) AS rank FROM s QUALIFY rank <= 64""")
def item_item_neighbors(spark, d):
    found = cf.item_item_neighbors(domain.ratings(spark, d))
    return found.select("item_id", "neighbor_id", "n", four(F.col("similarity"), "similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {RATINGS}, {CENTRED}, seeds AS (SELECT user_id AS session_id, item_id, greatest(rating - 3, 0.25) AS w FROM ratings WHERE user_id % 100 = 0 AND rating >= 4),
  hop AS (SELECT session_id, user_id, max(w) AS w FROM seeds JOIN centred USING (item_id) WHERE rating >= 4 GROUP BY ALL),
  met AS (SELECT session_id, item_id, count(*) AS support, sum(w * greatest(c, 0)) AS weighted, avg(rating) AS mean FROM hop JOIN centred USING (user_id) WHERE rating >= 4 AND (session_id, item_id) NOT IN (SELECT (user_id, item_id) FROM ratings WHERE user_id % 100 = 0) GROUP BY ALL)
  SELECT session_id, item_id, support, round(weighted + ln(1 + support) + mean / 5, 4) AS score FROM met WHERE weighted > 0""")
def two_hop_colike(spark, d):
    return cf.two_hop(_profile(spark, d), domain.ratings(spark, d))


@query(f"WITH {RATINGS}, pool AS (SELECT item_id FROM ratings GROUP BY item_id ORDER BY count(*) DESC, avg(rating) DESC, item_id LIMIT 50) SELECT DISTINCT u.user_id, pool.item_id FROM (SELECT DISTINCT user_id FROM ratings) u, pool WHERE (u.user_id, pool.item_id) NOT IN (SELECT (user_id, item_id) FROM ratings)")
def left_anti_unseen(spark, d):
    ratings = domain.ratings(spark, d)
    pool = ev.candidate_pool(ratings, 50)
    return ratings.select("user_id").distinct().crossJoin(F.broadcast(pool)).join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


@query()
def near_vectors(spark, d):
    """Ten neighbours of the embeddings whose id is divisible by 100, among all."""
    rows = domain.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return cf.near_vectors(rows, rows.filter("id % 100 = 0")).select("id", "neighbour", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


# Splits, metrics and fusion.


def _split(spark: SparkSession, d: str) -> DataFrame:
    return ev.time_split(domain.ratings(spark, d), 0.2, 12).persist()


@query(f"WITH {RATINGS}, {SPLIT} SELECT user_id, item_id, rating, split FROM split")
def time_split(spark, d):
    return _split(spark, d).select("user_id", "item_id", "rating", "split")


@query(f"""WITH {RATINGS}, w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ratings), c AS (SELECT *, greatest(CAST(round_even(n * 0.2, 0) AS BIGINT), 1) AS part FROM w WHERE n >= 3)
  SELECT user_id, item_id, CASE WHEN rn <= n - 2 * part THEN 'train' WHEN rn <= n - part THEN 'ranker' ELSE 'test' END AS split FROM c WHERE n - 2 * part >= 1""")
def three_way_split(spark, d):
    return ev.three_way_split(domain.ratings(spark, d)).select("user_id", "item_id", "split")


@query(f"WITH {RATINGS}, {SPLIT}, {QUALITY} SELECT item_id, round(quality, 6) AS quality FROM quality")
def quality_scores(spark, d):
    return ev.quality_scores(_split(spark, d).filter("split = 'train'")).select("item_id", F.round("quality", 6).alias("quality"))


@query(f"WITH {RATINGS}, {SPLIT}, m AS (SELECT item_id, avg(rating) AS mean FROM split WHERE split = 'train' GROUP BY item_id) SELECT item_id, round(CASE WHEN max(mean) OVER () <= min(mean) OVER () THEN 1.0 ELSE (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) END, 6) AS bias FROM m")
def bias_scores(spark, d):
    return ev.bias_scores(_split(spark, d).filter("split = 'train'")).select("item_id", F.round("bias", 6).alias("bias"))


RANKED = f"""{QUALITY}, users AS (SELECT DISTINCT user_id FROM split), ranked AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(quality, 8) DESC, item_id) AS rank FROM users, quality WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM split WHERE split = 'train') QUALIFY rank <= 10),
  relevant AS (SELECT user_id, item_id FROM split WHERE split = 'test' AND rating >= 4), sizes AS (SELECT user_id, count(*) AS size FROM relevant GROUP BY user_id),
  marked AS (SELECT r.user_id, r.item_id, r.rank, CASE WHEN v.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r JOIN sizes USING (user_id) LEFT JOIN relevant v ON v.user_id = r.user_id AND v.item_id = r.item_id),
  gains AS (SELECT *, hit * sum(hit) OVER (PARTITION BY user_id ORDER BY rank) / rank AS gain FROM marked), by_user AS (SELECT user_id, size, sum(hit) AS hits, sum(gain) AS gain FROM gains JOIN sizes USING (user_id) GROUP BY ALL)"""


@query(f"""WITH {RATINGS}, {SPLIT}, {RANKED} SELECT count(*) AS users, round(avg(hits / 10), 6) AS precision_at_k, round(avg(hits / size), 6) AS recall_at_k, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k,
  round(avg(gain / least(size, 10)), 6) AS map_at_k, round((SELECT count(DISTINCT item_id) FROM marked) / (SELECT count(*) FROM quality), 6) AS catalog_coverage FROM by_user""")
def ranking_metrics_popular(spark, d):
    rows = _split(spark, d)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    quality = ev.quality_scores(train)
    ranked = ev.rank_static(quality, "quality", rows.select("user_id").distinct(), train, 10)
    return ev.ranking_metrics(ranked, test.filter("rating >= 4"), 10, quality.count())


@query(f"""WITH {RATINGS}, {SPLIT}, mu AS (SELECT avg(rating) AS mu FROM split WHERE split = 'train'), i AS (SELECT item_id, sum(rating - mu) / (count(*) + 10) AS b FROM split, mu WHERE split = 'train' GROUP BY item_id),
  u AS (SELECT user_id, sum(rating - mu - b) / (count(*) + 10) AS a FROM split JOIN i USING (item_id), mu WHERE split = 'train' GROUP BY user_id)
  SELECT count(*) AS n, round(sqrt(avg((rating - least(greatest(mu + coalesce(a, 0) + coalesce(b, 0), 1), 5)) ** 2)), 6) AS rmse FROM split LEFT JOIN i USING (item_id) LEFT JOIN u USING (user_id), mu WHERE split = 'test'""")
def rmse_bias(spark, d):
    rows = _split(spark, d)
    mu, users, items = factors.biases(rows.filter("split = 'train'"), 10.0)
    model = factors.Model(mu, users.withColumn("p", F.lit(None).cast("array<float>")), items.withColumn("q", F.lit(None).cast("array<float>")))
    return ev.rmse(model.predict(rows.filter("split = 'test'").select("user_id", "item_id", "rating")))


ROUTES = f"""{QUALITY}, bias AS (SELECT item_id, avg(rating) AS b FROM split WHERE split = 'train' GROUP BY item_id), plenty AS (SELECT item_id, count(*) AS n FROM split WHERE split = 'train' GROUP BY item_id),
  routes AS (SELECT 'quality' AS source, item_id, quality AS score FROM quality QUALIFY row_number() OVER (ORDER BY round(quality, 8) DESC, item_id) <= 200
    UNION ALL SELECT 'bias', item_id, b FROM bias QUALIFY row_number() OVER (ORDER BY round(b, 8) DESC, item_id) <= 200
    UNION ALL SELECT 'count', item_id, CAST(n AS DOUBLE) FROM plenty QUALIFY row_number() OVER (ORDER BY n DESC, item_id) <= 200)"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    train = _split(spark, d).filter("split = 'train'")
    stats = train.groupBy("item_id").agg(F.avg("rating").alias("b"), F.count(F.lit(1)).cast("double").alias("n"))
    first = lambda df, c: df.orderBy(F.desc(F.round(c, 8)), "item_id").limit(200).select("item_id", F.col(c).alias("score"))
    parts = [first(ev.quality_scores(train), "quality").withColumn("source", F.lit("quality")), first(stats, "b").withColumn("source", F.lit("bias")), first(stats, "n").withColumn("source", F.lit("count"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("source", "item_id", "score")


@query(f"""WITH {RATINGS}, {SPLIT}, {ROUTES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 8) DESC, item_id) AS rank FROM routes)
  SELECT item_id, round(sum(CASE source WHEN 'quality' THEN 1.25 WHEN 'bias' THEN 0.9 ELSE 1.0 END / (20.0 + rank)), 6) AS score, count(*) AS sources FROM r WHERE rank <= CASE source WHEN 'quality' THEN 100 WHEN 'bias' THEN 60 ELSE 80 END GROUP BY item_id""")
def rrf_fusion(spark, d):
    found = recall.rrf(_routes(spark, d), {"quality": 100, "bias": 60, "count": 80}, {"quality": 1.25, "bias": 0.9, "count": 1.0}, 20.0)
    return found.select("item_id", F.round("score", 6).alias("score"), F.size("sources").cast("long").alias("sources"))


@query(f"WITH {RATINGS}, {SPLIT}, {ROUTES}, n AS (SELECT source, item_id, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM routes WINDOW w AS (PARTITION BY source)) SELECT item_id, round(sum(v), 6) AS score, count(*) AS sources FROM n GROUP BY item_id")
def legacy_fusion(spark, d):
    return recall.legacy_fusion(_routes(spark, d)).select("item_id", F.round("score", 6).alias("score"), F.size("sources").cast("long").alias("sources"))


@query(f"""WITH {RATINGS}, {SPLIT}, {ROUTES}, rel AS (SELECT DISTINCT item_id FROM split WHERE split = 'test' AND rating >= 5), a AS (SELECT item_id, count(*) AS k FROM routes GROUP BY item_id),
  m AS (SELECT source, r.item_id, k, CASE WHEN rel.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM routes r JOIN a USING (item_id) LEFT JOIN rel ON rel.item_id = r.item_id)
  SELECT source, count(*) AS candidates, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 6) AS precision, round(sum(hit) / (SELECT count(*) FROM rel), 6) AS recall, round(sum(CASE WHEN k = 1 THEN hit ELSE 0 END) / (SELECT count(*) FROM rel), 6) AS marginal_recall FROM m GROUP BY source""")
def source_marginal_recall(spark, d):
    test = _split(spark, d).filter("split = 'test' and rating >= 5")
    return recall.source_metrics(_routes(spark, d), test)


@query(f"WITH {RATINGS} SELECT user_id, item_id, round(CASE WHEN max(rating) OVER w <= min(rating) OVER w THEN 1.0 ELSE (rating - min(rating) OVER w) / (max(rating) OVER w - min(rating) OVER w) END, 6) AS normal FROM ratings WINDOW w AS (PARTITION BY user_id)")
def minmax_by_user(spark, d):
    rows = domain.ratings(spark, d).withColumn("score", F.col("rating"))
    return ev.min_max_by_user(rows).select("user_id", "item_id", F.round("normal", 6).alias("normal"))


@query(f"WITH {RATINGS} SELECT user_id, item_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY rating, item_id DESC) - 1) / (count(*) OVER (PARTITION BY user_id) - 1) END, 6) AS percentile FROM ratings")
def rank_percentiles(spark, d):
    user = Window.partitionBy("user_id")
    place = rank_percentile(user.orderBy("rating", F.desc("item_id")), user)
    return domain.ratings(spark, d).select("user_id", "item_id", F.round(place, 6).alias("percentile"))


@query(f"WITH {RATINGS}, {ITEMS}, y AS (SELECT user_id, avg(release_year) AS mean_year FROM ratings JOIN items USING (item_id) WHERE rating >= 4 GROUP BY user_id) SELECT user_id, item_id, round(exp(-abs(release_year - mean_year) / 18), 6) AS affinity FROM ratings JOIN items USING (item_id) JOIN y USING (user_id)")
def year_affinity_scores(spark, d):
    joined = domain.ratings(spark, d).join(domain.items(spark, d).select("item_id", "release_year"), "item_id")
    means = joined.filter("rating >= 4").groupBy("user_id").agg(F.avg("release_year").alias("mean_year"))
    return joined.join(means, "user_id").select("user_id", "item_id", F.round(year_affinity(F.col("release_year"), F.col("mean_year")), 6).alias("affinity"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, 65)) AS k FROM embeddings), c AS (SELECT label, k, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY ALL)
  SELECT vec_id, round(sum(CAST(v AS DOUBLE) * m) / (sqrt(sum(CAST(v AS DOUBLE) ** 2)) * sqrt(sum(m ** 2))), 4) AS cosine FROM e JOIN c ON c.label = e.label AND c.k = e.k GROUP BY vec_id""")
def profile_centroid_cosine(spark, d):
    rows = domain.table(spark, d, "embeddings")
    made = rows.select(F.col("label").alias("user_id"), F.col("vec_id").alias("item_id"), F.lit(4.0).alias("rating"))
    centres = factors.centroids(made, rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")))
    both = rows.join(centres, rows["label"] == centres["user_id"])
    return both.select("vec_id", F.round(factors.cosine("embedding", "centroid"), 4).alias("cosine"))


@query(f"""WITH {RATINGS}, {SPLIT}, {QUALITY}, t AS (SELECT 'quality' AS trial, count(*) AS n, round(avg(quality), 4) AS score FROM quality UNION ALL SELECT 'train', count(*), round(avg(rating), 4) FROM split WHERE split = 'train' UNION ALL SELECT 'test', count(*), round(avg(rating), 4) FROM split WHERE split = 'test')
  SELECT trial, n, score FROM t ORDER BY score DESC, n DESC LIMIT 1""")
def max_by_best_trial(spark, d):
    rows = _split(spark, d)
    parts = [ev.quality_scores(rows.filter("split = 'train'")).agg(F.count(F.lit(1)).alias("n"), four(F.avg("quality"), "score")).withColumn("trial", F.lit("quality"))]
    parts += [rows.filter(F.col("split") == s).agg(F.count(F.lit(1)).alias("n"), four(F.avg("rating"), "score")).withColumn("trial", F.lit(s)) for s in ("train", "test")]
    return ev.best_row(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("trial", "n", "score"), ["score", "n"])


# Sessions.

KEPT = f"{EVENTS}, kept AS (SELECT * FROM (SELECT *, max(CASE WHEN event_type = 'reset' THEN seq END) OVER (PARTITION BY session_id) AS last_reset FROM events_) WHERE (last_reset IS NULL OR seq > last_reset) AND event_type <> 'reset')"
AGED = f"{KEPT}, aged AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) - 1 AS age FROM kept QUALIFY age < 240)"


@query(f"WITH {KEPT} SELECT session_id, seq, event_type, item_id FROM kept")
def session_since_reset(spark, d):
    return sessions.since_reset(domain.events(spark, d)).select("session_id", "seq", "event_type", "item_id")


@query(f"""WITH {AGED}, w AS (SELECT *, CASE event_type WHEN 'like' THEN 7.0 WHEN 'dislike' THEN -7.5 ELSE 2.8 END AS weight FROM aged)
  SELECT session_id, seq, CAST(age AS BIGINT) AS age, round(weight * 0.985 ** age * CASE WHEN event_type = 'view' THEN 0.66 ELSE 1.0 END, 6) AS long_weight,
  round(CASE WHEN age < 25 THEN weight * 0.82 ** age * CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.85 END ELSE 0.0 END, 6) AS short_weight, round(CASE WHEN event_type = 'view' THEN 0.0 ELSE abs(weight) * 0.992 ** age END, 6) AS explicit_weight FROM w""")
def decayed_event_weights(spark, d):
    found = sessions.event_weights(sessions.recent(sessions.since_reset(domain.events(spark, d))))
    return found.select("session_id", "seq", F.col("age").cast("long").alias("age"), *[F.round(c, 6).alias(c) for c in ("long_weight", "short_weight", "explicit_weight")])


@query(f"""WITH {KEPT}, r AS (SELECT *, CASE event_type WHEN 'like' THEN 5.0 WHEN 'dislike' THEN 1.0 ELSE 3.6 END AS rating, CASE event_type WHEN 'view' THEN 0.35 ELSE 1.0 END AS confidence FROM kept WHERE item_id IS NOT NULL)
  SELECT session_id, item_id, CAST(rating AS DOUBLE) AS rating, CAST(confidence AS DOUBLE) AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY session_id, item_id ORDER BY confidence DESC, ts DESC, seq DESC) = 1""")
def active_profile(spark, d):
    return sessions.active_profile(sessions.since_reset(domain.events(spark, d)))


@query(f"WITH {ITEMS}, {KEPT}, r AS (SELECT session_id, item_id, CASE event_type WHEN 'like' THEN 5.0 WHEN 'dislike' THEN 1.0 ELSE 3.6 END AS rating FROM kept WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, item_id ORDER BY CASE event_type WHEN 'view' THEN 0.35 ELSE 1.0 END DESC, ts DESC, seq DESC) = 1) SELECT session_id, count(*) AS n, count(*) FILTER (rating >= 3.6) AS positives, count(*) FILTER (rating <= 2) AS negatives, round(avg(rating), 4) AS mean, round(avg(release_year) FILTER (rating >= 3.6), 4) AS positive_year FROM r LEFT JOIN items USING (item_id) GROUP BY session_id")
def session_profile_stats(spark, d):
    found = sessions.profile_stats(sessions.active_profile(sessions.since_reset(domain.events(spark, d))), domain.items(spark, d))
    return found.select("session_id", "n", "positives", "negatives", four(F.col("mean"), "mean"), four(F.col("positive_year"), "positive_year"))


@query()
def for_you(spark, d):
    """Ten items for every session that has given signals, by quota and in turns."""
    profiles, events = _profiles(spark, d).persist(), sessions.since_reset(domain.events(spark, d))
    weighted, own = sessions.event_weights(sessions.recent(events)), vectors.content_vectors(profiles).persist()
    profile = sessions.active_profile(events)
    shared = cf.score_candidates(cf.profile_neighbors(profile, domain.ratings(spark, d), cf.SMALL_SESSION), domain.ratings(spark, d), profile, cf.SMALL_SESSION)
    found = sessions.for_you_everyone(sessions.preference_vectors(weighted, own), own, profiles, events.filter("item_id is not null"), 10, shared).persist()
    listed = found.join(profiles.select("item_id", "genres", "tags"), "item_id")
    liked = profile.filter("rating >= 3.6").join(profiles.select("item_id", F.explode("genres").alias("genre")), "item_id").groupBy("session_id", "genre").count()
    liked = top(liked, "session_id", [F.desc("count"), F.asc("genre")], 5).select("session_id", "genre", "rank")
    return selection.interleave(selection.blend(listed, liked, 10)).select("session_id", "item_id", "bucket", "shown")


@query()
def diversify(spark, d):
    profiles = _profiles(spark, d).select(F.lit(0).alias("session_id"), "item_id", "genres", F.col("comprehensive_score").alias("value"))
    return selection.diversify(profiles, 20)


@query()
def mmr_select(spark, d):
    rows = domain.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return selection.mmr(rows.withColumn("relevance", 1.0 / (1 + F.col("item_id"))), 10)


# Learned models.

NEGATIVES = f"""{RATINGS}, {SPLIT}, {QUALITY}, rows_ AS (SELECT user_id, item_id, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS label, round(0.35 * 0 + 0.35 * quality, 8) AS hardness FROM split JOIN quality USING (item_id) WHERE split = 'train'),
  worst AS (SELECT user_id, item_id AS negative, row_number() OVER (PARTITION BY user_id ORDER BY hardness DESC, item_id) AS rank FROM rows_ WHERE label = 0 QUALIFY rank <= 4)"""


@query(f"WITH {NEGATIVES} SELECT user_id, r.item_id AS positive, negative, rank FROM rows_ r JOIN worst USING (user_id) WHERE label = 1")
def pairwise_hard_negatives(spark, d):
    train = _split(spark, d).filter("split = 'train'")
    rows = train.join(ev.quality_scores(train), "item_id").withColumn("label", (F.col("rating") >= 4).cast("int"))
    return rerank.hard_pairs(rows, 0.35 * F.col("quality")).select("user_id", "positive", "negative", F.col("rank").cast("long").alias("rank"))


@query()
def als_recs(spark, d):
    """Ten items of the default pool for every user with enough ratings."""
    train, config = _split(spark, d).filter("split = 'train'").persist(), ev.Config()  # the model, the pool and the history read it
    users = ev.rated_users(train, config.min_ratings)
    found = factors.fit(train).recommend(users, ev.candidate_pool(train, config.pool), train, 10)
    return found.select("user_id", "item_id", F.round("prediction", 4).alias("prediction"), "rank")


def _ltr_matrix(spark, d):
    """Features of every later rating of all users with enough ratings, by models fitted on the earlier ones."""
    rows = ev.three_way_split(domain.ratings(spark, d), min_ratings=12)
    train, items = rows.filter("split = 'train'").persist(), domain.items(spark, d)  # each model reads it
    users, quality = ev.rated_users(train, ev.Config().min_ratings), ev.quality_scores(train)
    pairs = rows.filter("split <> 'train'").join(users, "user_id", "left_semi").select("user_id", "item_id", "split", (F.col("rating") >= 4).cast("int").alias("label"))
    found = candidates.recalled(train, items, users, quality, 600)
    return rerank.feature_matrix(pairs, train, items, quality, found.extras(pairs, train))


@query()
def ltr_scores(spark, d):
    """Scores of a pointwise ranker on the users' later ratings, trained on the middle ones."""
    matrix = _ltr_matrix(spark, d).persist()  # each stage of the fit reads it
    ranker = rerank.fit_pointwise(matrix.filter("split = 'ranker'"))
    return ranker.score(matrix.filter("split = 'test'")).select("user_id", "item_id", "label", F.round("ranker_score", 6).alias("ranker_score"))


@query()
def recall_pool(spark, d):
    """The fused candidate pool of all six routes for every user with enough ratings."""
    rows = _split(spark, d).persist()  # the model and each route read it
    train, items = rows.filter("split = 'train'"), domain.items(spark, d)
    users, quality = ev.rated_users(train, ev.Config().min_ratings), ev.quality_scores(train)
    routes = candidates.recalled(train, items, users, quality, 600).routes
    test = rows.filter("split = 'test' and rating >= 4").join(users, "user_id", "left_semi")
    pool, _ = recall.build_pool(routes, test, quality, 600, 20.29)
    return pool.select("item_id", F.round("score", 6).alias("score"), F.array_join("sources", "|").alias("sources"))
