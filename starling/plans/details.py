"""More registered queries: the smaller operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import log_share, sigmoid, top, z_score
from ..functions.text import canonical_tag, facet, singular, split_pipe, tag_key, token_similarity, tokens
from ..operators import aliases, collaborative as cf, evaluation as ev, recall, rerank, scoring, search, selection, sessions, tuning, vectors
from ..sources import domain, files
from .catalog import AGED, CENTRED, EVENTS, ITEMS, LIKED, QUALITY, RATINGS, RAW, ROUTES, SPLIT, TAGS, _routes, _split, query

SIX = 6


def six(c, name: str):
    return F.round(c, SIX).alias(name)


# Texts.


@query("""SELECT p_partkey AS item_id, list_filter(list_transform(string_split(p_name || ' | ' || p_brand || '||' || p_type, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part""")
def pipe_lists(spark, d):
    joined = F.concat_ws("", F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit("||"), F.col("p_type"))
    return domain.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), split_pipe(joined).alias("parts"))


@query("SELECT p_partkey AS item_id, regexp_extract_all(lower(p_brand || '/' || p_type), '[a-z0-9]+') AS words, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_brand || '/' || p_type)), '[_/]+', ' ', 'g'), '[^a-z0-9+#.\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part".replace("\\\\", "\\"))
def tokens_and_keys(spark, d):
    c = F.concat_ws("/", "p_brand", "p_type")
    return domain.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), tokens(c).alias("words"), tag_key(c).alias("key"))


@query(f"WITH {EVENTS}, e AS (SELECT 'tag ' || (session_id % 20) AS source, 'tag ' || (session_id % 7 + 20) AS target, CASE event_type WHEN 'like' THEN 'accept' WHEN 'dislike' THEN 'reject' ELSE 'ignore' END AS decision, seq FROM events_) SELECT source, target, decision FROM e QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY seq DESC) = 1")
def latest_decisions(spark, d):
    events = domain.events(spark, d)
    decision = F.when(F.col("event_type") == "like", "accept").when(F.col("event_type") == "dislike", "reject").otherwise("ignore")
    rows = events.select(F.concat(F.lit("Tag_"), F.col("session_id") % 20).alias("source"), F.concat(F.lit("tag "), F.col("session_id") % 7 + 20).alias("target"), decision.alias("decision"), F.col("seq").cast("double").alias("ts"))
    return aliases.latest_decisions(rows).select("source", "target", "decision")


@query(f"WITH {TAGS} SELECT DISTINCT lower(tag) AS tag, 'theme' AS facet, CASE WHEN length(tag) > 4 AND tag LIKE '%ies' THEN substr(tag, 1, length(tag) - 3) || 'y' WHEN length(tag) > 3 AND tag LIKE '%s' AND tag NOT LIKE '%ss' THEN substr(tag, 1, length(tag) - 1) ELSE tag END AS singular FROM tags")
def canonical_tags(spark, d):
    named = domain.tags(spark, d).select(canonical_tag(F.col("tag")).alias("tag")).distinct()
    return named.select("tag", facet(F.col("tag")).alias("facet"), singular(F.col("tag")).alias("singular"))


@query("""WITH t AS (SELECT p_name AS a, list_distinct(string_split(p_name, ' ')) AS x, bool_or(p_partkey % 100 = 0) AS q FROM part GROUP BY p_name), p AS (SELECT l.a AS a, r.a AS b, len(list_intersect(l.x, r.x)) AS n, least(len(l.x), len(r.x)) AS m, len(list_distinct(list_concat(l.x, r.x))) AS u FROM t l JOIN t r ON l.q AND l.a <> r.a)
  SELECT a, b, round(greatest(n / u, 0.86 * CASE WHEN n >= 2 THEN n / m ELSE 0 END), 6) AS similarity FROM p WHERE n > 0""")
def token_similarities(spark, d):
    """Titles of the items whose id is divisible by 100, against all."""
    items = domain.items(spark, d)
    words = lambda df: df.select("title").distinct().withColumn("x", F.array_distinct(F.split("title", " "))).select("title", "x", F.explode("x").alias("w"))  # noqa: E731  pairs share a word
    both = words(items.filter("item_id % 100 = 0")).alias("l").join(words(items).alias("r"), "w").filter("l.title <> r.title").select(F.col("l.title").alias("a"), F.col("r.title").alias("b"), F.col("l.x").alias("x"), F.col("r.x").alias("y")).distinct()
    return both.select("a", "b", six(token_similarity(F.col("x"), F.col("y")), "similarity"))


@query(f"WITH {ITEMS} SELECT 'title' AS field, lower(trim(title)) AS key, item_id FROM items UNION SELECT 'genre', lower(trim(unnest(genres))), item_id FROM items")
def phrase_postings(spark, d):
    return search.postings(domain.items(spark, d))


@query(f"WITH {ITEMS}, p AS (SELECT 'title' AS field, lower(title) AS key, item_id FROM items UNION SELECT 'genre', lower(unnest(genres)), item_id FROM items) SELECT DISTINCT field, unnest(regexp_extract_all(key, '[a-z0-9]+')) AS token, item_id FROM p")
def token_postings(spark, d):
    return search.token_postings(search.postings(domain.items(spark, d)))


@query(f"WITH {ITEMS}, k AS (SELECT DISTINCT 'title' AS field, lower(title) AS key FROM items UNION SELECT DISTINCT 'genre', lower(unnest(genres)) FROM items) SELECT DISTINCT field, substr(key, CAST(i AS INTEGER), 2) AS gram, key FROM k, unnest(range(1, greatest(length(key), 2))) AS u(i)")
def bigram_postings(spark, d):
    return search.bigram_index(search.postings(domain.items(spark, d)))


# Ratings.


@query(f"WITH {RATINGS} SELECT user_id, item_id, rating, ts FROM ratings QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) <= 120")
def user_histories(spark, d):
    return top(domain.ratings(spark, d), "user_id", [F.desc("ts"), F.asc("item_id")], 120).drop("rank")


@query(f"WITH {RATINGS} SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= 12 ORDER BY user_id LIMIT 160")
def eligible_users(spark, d):
    return ev.eligible_users(domain.ratings(spark, d), ev.Config())


@query(f"WITH {RATINGS} SELECT item_id FROM ratings GROUP BY item_id ORDER BY count(*) DESC, avg(rating) DESC, item_id LIMIT 300")
def candidate_pool(spark, d):
    return ev.candidate_pool(domain.ratings(spark, d), 300)


@query(f"WITH {RATINGS} SELECT user_id, item_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) <= round_even(count(*) OVER (PARTITION BY user_id) * 0.5, 0) THEN 'validation' ELSE 'fit' END AS part FROM ratings")
def fit_validation_split(spark, d):
    return ev.fit_validation_split(domain.ratings(spark, d)).select("user_id", "item_id", "part")


@query(f"WITH {RATINGS}, z AS (SELECT user_id, item_id, rating, avg(rating) OVER w AS m, stddev_pop(rating) OVER w AS s FROM ratings WINDOW w AS (PARTITION BY user_id)) SELECT user_id, item_id, round((rating - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END, 6) AS z, round(1 / (1 + exp(-(rating - 3))), 6) AS sigmoid FROM z")
def z_scores(spark, d):
    return domain.ratings(spark, d).select("user_id", "item_id", six(z_score(F.col("rating"), Window.partitionBy("user_id")), "z"), six(sigmoid(F.col("rating") - 3), "sigmoid"))


@query(f"WITH {RATINGS}, {LIKED} SELECT user_id, item_id FROM liked")
def bounded_positives(spark, d):
    return cf.positives(domain.ratings(spark, d)).select("user_id", "item_id")


@query(f"WITH {RATINGS}, {CENTRED} SELECT user_id, item_id, round(c, 6) AS c, round(norm, 6) AS norm FROM centred")
def centred_ratings(spark, d):
    return cf.centred(domain.ratings(spark, d)).filter("norm > 1e-9").select("user_id", "item_id", six(F.col("c"), "c"), six(F.col("norm"), "norm"))


ITEM_ITEM = f"""{LIKED}, m AS (SELECT item_id, count(*) AS m FROM liked GROUP BY item_id), both_ AS (SELECT x.item_id, y.item_id AS neighbor_id, count(*) AS n FROM liked x JOIN liked y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY ALL HAVING count(*) >= 2),
  near AS (SELECT b.item_id, neighbor_id, round(n / sqrt(mx.m * my.m) * n / (n + 10), 8) AS similarity FROM both_ b JOIN m mx ON mx.item_id = b.item_id JOIN m my ON my.item_id = neighbor_id QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY round(n / sqrt(mx.m * my.m) * n / (n + 10), 8) DESC, neighbor_id) <= 64)"""


@query(f"""WITH {RATINGS}, {ITEM_ITEM}, seeds AS (SELECT user_id AS session_id, item_id AS seed, greatest(rating - 3, 0.25) AS w, count(*) OVER (PARTITION BY user_id) AS seeds FROM ratings WHERE user_id % 100 = 0 AND rating >= 4)
  SELECT session_id, neighbor_id AS item_id, round(sum(w * similarity) / sqrt(any_value(seeds)), 6) AS score FROM seeds JOIN near ON near.item_id = seed GROUP BY ALL""")
def item_item_scores(spark, d):
    ratings = domain.ratings(spark, d)
    own = ratings.filter("user_id % 100 = 0").withColumnRenamed("user_id", "session_id")
    return cf.item_item_scores(own, cf.item_item_neighbors(ratings)).select("session_id", "item_id", six(F.col("score"), "score"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS cosine FROM e q, e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
  SELECT query_id, vec_id, round(cosine, 4) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.cosine DESC, vec_id) <= 10""")
def nearest_vectors(spark, d):
    from ..operators.factors import cosine

    rows = domain.table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))  # the stated query set, against all rows
    both = rows.join(queries, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(cosine("embedding", "q"), 6).alias("cosine"))
    return top(both, "query_id", [F.desc("cosine"), F.asc("vec_id")], 10).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))


# Routes and rankings.


@query(f"WITH {RATINGS}, {SPLIT}, {QUALITY} SELECT item_id, round(quality + CASE WHEN n <= 1 THEN 0 ELSE 1 - (rank - 1) / (n - 1) END, 6) AS score FROM (SELECT *, count(*) OVER () AS n FROM (SELECT item_id, quality, row_number() OVER (ORDER BY round(quality, 8) DESC, item_id) AS rank FROM quality QUALIFY rank <= 200))")
def popular_route(spark, d):
    quality = ev.quality_scores(_split(spark, d).filter("split = 'train'"))
    return recall.popular_route(quality, 200).select("item_id", six(F.col("score"), "score"))


@query(f"""WITH {RATINGS}, {SPLIT}, {QUALITY}, {ITEMS}, means AS (SELECT user_id, round(avg(release_year), 0) AS y FROM split JOIN items USING (item_id) WHERE split = 'train' AND rating >= 4 GROUP BY user_id),
  v AS (SELECT y, item_id, round(0.7 * exp(-abs(release_year - y) / 18) + 0.3 * quality, 8) AS value FROM (SELECT DISTINCT y FROM means), items JOIN quality USING (item_id) QUALIFY row_number() OVER (PARTITION BY y ORDER BY value DESC, item_id) <= 50)
  SELECT user_id, item_id, round(value, 6) AS value FROM means JOIN v USING (y)""")
def year_route(spark, d):
    train = _split(spark, d).filter("split = 'train'")
    found = recall.year_values(train, domain.items(spark, d), ev.quality_scores(train), 50)
    return found.select("user_id", "item_id", six(F.round("value", 8), "value"))


@query(f"""WITH {RATINGS}, {SPLIT}, {ROUTES}, n AS (SELECT source, item_id, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM routes WINDOW w AS (PARTITION BY source)),
  g AS (SELECT item_id, sum(v) AS total, count(*) AS k, max(CASE WHEN source = 'quality' THEN v ELSE 0 END) AS q, max(CASE WHEN source = 'bias' THEN v ELSE 0 END) AS b FROM n GROUP BY item_id)
  SELECT item_id, CAST(1 AS DOUBLE) AS route_surfaced, round(total / max(total) OVER (), 6) AS route_score, round(k / 3, 6) AS route_sources, round(q, 6) AS route_quality, round(b, 6) AS route_bias FROM g""")
def route_features(spark, d):
    found = recall.route_features(_routes(spark, d), ["quality", "bias", "count"])
    return found.select("item_id", "route_surfaced", *[six(F.col(c), c) for c in ("route_score", "route_sources", "route_quality", "route_bias")])


STATS = """st AS (SELECT item_id, avg(rating) AS i_avg, count(*) AS i_n FROM split WHERE split = 'train' GROUP BY item_id), us AS (SELECT user_id, avg(rating) AS u_avg, count(*) AS u_n, count(*) FILTER (rating >= 4) AS u_pos, avg(release_year) FILTER (rating >= 4) AS u_year FROM split JOIN items USING (item_id) WHERE split = 'train' GROUP BY user_id),
  k AS (SELECT (SELECT avg(rating) FROM split WHERE split = 'train') AS mu, (SELECT max(i_n) FROM st) AS i_most, (SELECT max(u_n) FROM us) AS u_most, (SELECT min(release_year) FROM items) AS y_low, (SELECT max(release_year) FROM items) AS y_high)"""


@query(f"""WITH {RATINGS}, {SPLIT}, {QUALITY}, {ITEMS}, {STATS} SELECT s.user_id, s.item_id, round(coalesce(quality, 0), 6) AS quality, round(coalesce(i_avg, mu) / 5, 6) AS item_avg, round(coalesce(ln(1 + i_n) / ln(1 + i_most), 0), 6) AS item_count, round(coalesce(u_avg, mu) / 5, 6) AS user_avg,
  round(coalesce(ln(1 + u_n) / ln(1 + u_most), 0), 6) AS user_count, round(least(coalesce(u_pos, 0) / 20, 1.0), 6) AS user_positives, round(coalesce(u_pos / u_n, 0), 6) AS user_positive_rate, round((release_year - y_low) / (y_high - y_low), 6) AS year, round(coalesce(exp(-abs(release_year - u_year) / 18), 0), 6) AS year_affinity
  FROM split s LEFT JOIN st USING (item_id) LEFT JOIN us USING (user_id) LEFT JOIN quality USING (item_id) JOIN items USING (item_id), k WHERE split = 'test'""")
def feature_matrix(spark, d):
    rows = _split(spark, d)
    train = rows.filter("split = 'train'")
    found = rerank.feature_matrix(rows.filter("split = 'test'").select("user_id", "item_id"), train, domain.items(spark, d), ev.quality_scores(train))
    shown = ["quality", "item_avg", "item_count", "user_avg", "user_count", "user_positives", "user_positive_rate", "year", "year_affinity"]
    return found.select("user_id", "item_id", *[six(F.col(c), c) for c in shown])


BIAS = """bias AS (SELECT item_id, CASE WHEN max(m) OVER () <= min(m) OVER () THEN 1.0 ELSE (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) END AS bias FROM (SELECT item_id, avg(rating) AS m FROM split WHERE split = 'train' GROUP BY item_id))"""
TESTED = f"{RATINGS}, {SPLIT}, {QUALITY}, {BIAS}, tested AS (SELECT user_id, item_id, rating, quality, bias FROM split JOIN quality USING (item_id) JOIN bias USING (item_id) WHERE split = 'test')"


def _tested(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d)
    train = rows.filter("split = 'train'")
    return rows.filter("split = 'test'").select("user_id", "item_id", "rating").join(ev.quality_scores(train), "item_id").join(ev.bias_scores(train), "item_id")


@query(f"WITH {TESTED} SELECT user_id, item_id, round(0.3552 * bias + 0.0841 * 0 + 0.5607 * quality, 6) AS hybrid FROM tested")
def hybrid_scores(spark, d):
    rows = _tested(spark, d).withColumnRenamed("bias", "mf").withColumn("cf", F.lit(0.0))
    return rows.select("user_id", "item_id", six(rerank.weighted(rerank.HYBRID), "hybrid"))


MM = "CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN 1.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
PLACE = "CASE WHEN count(*) OVER w <= 1 THEN 1.0 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY round({c}, 8), item_id DESC) - 1) / (count(*) OVER w - 1) END"


@query(f"WITH {TESTED} SELECT user_id, item_id, round(0.7 * {MM.format(c='quality')} + 0.3 * {MM.format(c='bias')}, 8) AS by_value, round(0.7 * {PLACE.format(c='quality')} + 0.3 * {PLACE.format(c='bias')}, 8) AS by_rank, round(least(greatest(bias + 0.2 * (quality - 0.5), 0), 1), 8) AS residual FROM tested WINDOW w AS (PARTITION BY user_id)")
def blended_scores(spark, d):
    q, b = F.col("quality"), F.col("bias")
    return _tested(spark, d).select("user_id", "item_id", F.round(rerank.blend(q, b, 0.7), 8).alias("by_value"), F.round(rerank.blend(q, b, 0.7, mode="rank"), 8).alias("by_rank"), F.round(rerank.add_residual(b, q - 0.5, 0.2), 8).alias("residual"))


@query(f"""WITH {TESTED}, grid AS (SELECT i / 20.0 AS weight FROM range(21) AS g(i)), mixed AS (SELECT weight, user_id, item_id, rating, row_number() OVER (PARTITION BY weight, user_id ORDER BY round(weight * quality + (1 - weight) * bias, 8) DESC, item_id) AS rank FROM tested, grid),
  hits AS (SELECT weight, user_id, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS hits FROM mixed WHERE rank <= 3 AND user_id IN (SELECT user_id FROM tested WHERE rating >= 4) GROUP BY ALL)
  SELECT CAST(weight AS DOUBLE) AS weight, round(avg(hits / 3), 6) AS precision_at_k, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k FROM hits GROUP BY weight""")
def blend_tuning(spark, d):
    rows = _tested(spark, d)
    scored = rows.select("user_id", "item_id", F.col("quality").alias("learned"), F.col("bias").alias("base"))
    return tuning.tune_blend(scored, rows.filter("rating >= 4"), 3)[1]


@query(f"""WITH {TESTED}, grid AS (SELECT 0.3 * i / 6 AS weight FROM range(7) AS g(i)), mixed AS (SELECT weight, user_id, item_id, rating, row_number() OVER (PARTITION BY weight, user_id ORDER BY round(least(greatest(bias + weight * (quality - 0.5), 0), 1), 8) DESC, item_id) AS rank FROM tested, grid),
  hits AS (SELECT weight, user_id, sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) AS hits FROM mixed WHERE rank <= 3 AND user_id IN (SELECT user_id FROM tested WHERE rating >= 4) GROUP BY ALL)
  SELECT round(CAST(weight AS DOUBLE), 6) AS weight, round(avg(hits / 3), 6) AS precision_at_k, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k FROM hits GROUP BY weight""")
def residual_tuning(spark, d):
    rows = _tested(spark, d)
    scored = rows.select("user_id", "item_id", F.col("bias").alias("base"), (F.col("quality") - 0.5).alias("residual"))
    return tuning.tune_residual(scored, rows.filter("rating >= 4"), 3)[1].withColumn("weight", F.round("weight", 6))


@query(f"WITH {TESTED}, c AS (SELECT * FROM tested QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 6), b AS (SELECT user_id, item_id, CASE item_id % 3 WHEN 0 THEN 'explore' WHEN 1 THEN 'collaborative' ELSE 'interest' END AS bucket, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS position FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY position) - 1 AS rn FROM b) SELECT user_id AS session_id, item_id, bucket, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN bucket = 'interest' THEN rn // 2 ELSE rn END, CASE bucket WHEN 'interest' THEN 0 WHEN 'collaborative' THEN 1 ELSE 2 END, rn) AS shown FROM r")
def interleaved(spark, d):
    rows = top(_tested(spark, d), "user_id", [F.asc("item_id")], 6)
    bucket = F.when(F.col("item_id") % 3 == 0, "explore").when(F.col("item_id") % 3 == 1, "collaborative").otherwise("interest")
    chosen = rows.select(F.col("user_id").alias("session_id"), "item_id", bucket.alias("bucket"), F.col("rank").alias("position"))
    return selection.interleave(chosen).select("session_id", "item_id", "bucket", F.col("shown").cast("long").alias("shown"))


@query(f"""WITH {TESTED}, own AS (SELECT user_id AS session_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS position FROM tested QUALIFY position <= 2), best AS (SELECT item_id, quality FROM quality ORDER BY round(quality, 6) DESC, item_id LIMIT 10),
  more AS (SELECT s.session_id, best.item_id, 1000000 + row_number() OVER (PARTITION BY s.session_id ORDER BY round(quality, 6) DESC, best.item_id) AS position FROM (SELECT DISTINCT session_id FROM own) s, best WHERE (s.session_id, best.item_id) NOT IN (SELECT (session_id, item_id) FROM own))
  SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY position) AS position FROM (SELECT * FROM own UNION ALL SELECT * FROM more) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY position) <= 5""")
def backfilled(spark, d):
    own = top(_tested(spark, d), "user_id", [F.asc("item_id")], 2).select(F.col("user_id").alias("session_id"), "item_id", F.col("rank").alias("position"))
    scores = ev.quality_scores(_split(spark, d).filter("split = 'train'")).select("item_id", F.round("quality", 6).alias("score"))
    return selection.backfill(own, scores, 5).select("session_id", "item_id", F.col("position").cast("long").alias("position"))


@query(f"WITH {TESTED}, u AS (SELECT user_id, item_id, 0 AS source FROM tested WHERE quality > 0.6 UNION ALL SELECT user_id, item_id, 1 FROM tested WHERE bias > 0.5) SELECT user_id, item_id, min(source) AS source FROM u GROUP BY ALL")
def ordered_union(spark, d):
    rows = _tested(spark, d)
    parts = rows.filter("quality > 0.6").select("user_id", "item_id", F.lit(0).alias("source")).unionByName(rows.filter("bias > 0.5").select("user_id", "item_id", F.lit(1).alias("source")))
    return parts.groupBy("user_id", "item_id").agg(F.min("source").alias("source"))


# Sessions and sinks.


@query(f"""WITH {AGED}, w AS (SELECT *, CASE event_type WHEN 'like' THEN 7.0 WHEN 'dislike' THEN -7.5 ELSE 2.8 END AS weight FROM aged),
  n AS (SELECT *, row_number() OVER (PARTITION BY session_id, item_id, event_type IN ('like', 'dislike') ORDER BY age) AS k FROM w)
  SELECT session_id, round(sum(abs(weight * 0.985 ** age * CASE WHEN event_type = 'view' THEN 0.66 ELSE 1.0 END)), 10) AS long, round(sum(CASE WHEN age < 25 THEN abs(weight * 0.82 ** age * CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.85 END) ELSE 0.0 END), 10) AS short,
  round(sum(CASE WHEN event_type = 'like' AND k = 1 THEN abs(weight) * 0.992 ** age ELSE 0.0 END), 10) AS explicit FROM n GROUP BY session_id""")
def session_strengths(spark, d):
    weighted = sessions.event_weights(sessions.recent(sessions.since_reset(domain.events(spark, d))))
    return sessions.strengths(weighted).select("session_id", *[F.round(c, 10).alias(c) for c in ("long", "short", "explicit")])


@query(f"WITH {EVENTS} SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events_ GROUP BY ALL")
def hourly_events(spark, d):
    from ..streaming.session_state import windowed_counts

    return windowed_counts(domain.events(spark, d)).select(F.col("window.start").alias("hour"), "event_type", "n")


@query(f"WITH {RAW} SELECT (SELECT count(*) FROM part) AS items, count(*) AS ratings, count(DISTINCT user_id) AS users, (SELECT count(*) FROM part) * 2 AS tags FROM raw")
def dashboard(spark, d):
    ratings = domain.raw_ratings(spark, d).agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("user_id").alias("users"))
    return domain.items(spark, d).agg(F.count(F.lit(1)).alias("items")).crossJoin(ratings).crossJoin(domain.tags(spark, d).agg(F.count(F.lit(1)).alias("tags")))


@query(f"WITH {RAW}, s AS (SELECT item_id, count(*) AS n FROM raw GROUP BY item_id) SELECT item_id, round(ln(1 + n) / ln(1 + max(n) OVER ()) * 25, 6) AS popularity FROM s")
def popularity(spark, d):
    stats = scoring.item_stats(domain.raw_ratings(spark, d))
    most = stats.agg(F.max("rating_count").alias("most"))
    return stats.crossJoin(F.broadcast(most)).select("item_id", six(log_share(F.col("rating_count"), F.col("most"), 25.0), "popularity"))


@query(f"WITH {RATINGS} SELECT 1 AS user_id, item_id, rating FROM ratings WHERE item_id IN (1, 2, 3) AND FALSE UNION ALL SELECT * FROM (VALUES (1, 5, 4.5), (1, 9, 3.0)) AS v(user_id, item_id, rating)")
def inline_values(spark, d):
    return files.inline_ratings(spark, [(5, 4.5), (9, 3.0)]).select(F.lit(1).alias("user_id"), "item_id", "rating")


@query(f"""WITH {TAGS}, c AS (SELECT item_id, 'tag:' || tag AS feature, count(*) AS value FROM tags GROUP BY ALL), q AS (SELECT feature, sum(value) AS v FROM c GROUP BY feature) SELECT feature, CAST(v * 2.5 AS DOUBLE) AS value FROM q""")
def vector_sums(spark, d):
    rows = domain.tags(spark, d).groupBy(F.concat(F.lit("tag:"), F.col("tag")).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return vectors.add_vectors((rows, 0.5), (rows, 2.0)).select("feature", six(F.col("value"), "value"))
