"""Requests on a dataset as plain functions, and a small HTTP server over them."""

from __future__ import annotations

import json
import tempfile
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .functions.numeric import top
from .operators import collaborative as cf, factors, recall, recommend, rerank, scoring, search, selection, sessions, vectors
from .pipelines import Dataset
from .sources.files import EVENT_TYPES, EventLog, read_artifact, table_columns


class Unsupported(Exception):
    """The dataset lacks what the request needs."""


def _between(name: str, n: int, low: int, high: int) -> int:
    if not low <= int(n) <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return int(n)


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]  # a page of results


class Service:
    """Serves one dataset. Events go to a log in the folder `events`, so that they outlive the process.

    artifact: a folder with a reranker's weights and summary, and perhaps a factor model; large catalogues then answer for-you by it.
    runtime: a folder of CSV rows for the dashboard.
    """

    def __init__(self, dataset: Dataset, events: str | None = None, artifact: str | None = None, runtime: str | None = None):
        self.data, self.spark, self.runtime = dataset, dataset.items.sparkSession, runtime
        self.log = EventLog(self.spark, events or f"{tempfile.mkdtemp(prefix='starling-')}/events")
        self.artifact = self._load(artifact) if artifact else None

    def _load(self, folder: str) -> dict | None:
        """The reranker, its settings and its factor model; None if the folder has no weights."""
        try:
            weights, summary = read_artifact(self.spark, folder, rerank.FEATURES)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        config = summary.get("config", {})
        priors = {p[0]: recall.Prior(*map(float, p[1:])) for p in config.get("candidate_recall_priors", [])} or recall.PRIORS
        model = factors.Model.load(self.spark, f"{folder}/model") if table_columns(self.spark, f"{folder}/model/items") else None
        return {"weights": weights, "model": model, "limit": int(config.get("candidate_limit", 600)), "k": float(config.get("candidate_recall_rrf_k", 20.0)), "priors": priors, "metric": summary.get("best_metric")}

    def health(self) -> dict:
        return {"ok": True, "dataset": self.data.name, "default": self.data.name, "available": [self.data.name]}

    def dashboard(self) -> dict:
        row = self.data.ratings.agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("user_id").alias("users")).first()
        found = {"dataset": self.data.display_name, "items": self.data.items.count(), "ratings": row.ratings, "users": row.users, "tags": self.data.tags.count() if self.data.has_tags else 0}
        if self.runtime:
            found["runtime"] = _rows(self.spark.read.option("header", True).csv(self.runtime).limit(1000))
        return found

    def top(self, n: int = 10, algorithm: str = "heap", score_mode: str = "default") -> dict:
        began = time.perf_counter()
        items = _rows(scoring.leaderboard(self.data.scores, _between("n", n, 1, 100), score_mode, algorithm))
        return {"items": items, "count": len(items), "score_key": scoring.SCORE_MODES[score_mode], "elapsed_ms": round(1000 * (time.perf_counter() - began), 3)}

    def search(self, kind: str, query: str, n: int = 10) -> dict:
        """The first n matches; count is of all of them."""
        if kind != "title" and not self.data.has_tags:
            raise ValueError(f"{self.data.name} has no {kind} search")
        found = search.indexed_search(self.data.scores, kind, query).persist()
        try:
            return {"items": _rows(found.limit(_between("n", n, 1, 100))), "count": found.count()}
        finally:
            found.unpersist()

    def _target(self, title: str) -> DataFrame:
        hit = search.indexed_search(self.data.scores, "title", title).limit(1).collect()
        if not hit:
            raise ValueError(f"nothing is called {title}")
        return self.data.items.filter(F.col("item_id") == hit[0].item_id)

    def recommend(self, title: str, n: int = 10) -> dict:
        n, target = _between("n", n, 1, 50), self._target(title)
        if self.data.has_tags:
            items = search.similar_items(self.data.scores, target.first().item_id, n)
        else:
            items = recommend.similar_items_large(target, self.data.scores, self.data.ratings, n)
        return {"target": _rows(target)[0], "items": _rows(items)}

    def event(self, session_id: str, event_type: str, item_id: int | None = None, kind: str | None = None, query: str | None = None, source: str | None = None, timestamp: float | None = None) -> dict:
        if not session_id or event_type not in EVENT_TYPES:
            raise ValueError("not an event")
        if kind in ("genre", "tag") and not self.data.has_tags:
            raise ValueError(f"{self.data.name} has no {kind} events")
        event = {"session_id": session_id, "event_type": event_type, "timestamp": timestamp, "kind": kind, "query": query, "movie_id": None if item_id is None else int(item_id), "source": source}
        return {"ok": True, "event_count": len(self.log.append(event))}

    def _events(self, session_id: str) -> DataFrame:
        rows = [(session_id, n, e["event_type"], e["timestamp"], e["movie_id"], e["source"]) for n, e in enumerate(self.log.of(session_id))]
        return self.spark.createDataFrame(rows, "session_id string, seq long, event_type string, ts double, item_id long, source string")

    def _answer(self, events: DataFrame, shown: DataFrame, order: str, n: int, near: DataFrame | None, engine: str, **more) -> dict:
        """The items shown, how many each bucket has, and what the neighbours were."""
        items = _rows(shown.drop("title").join(self.data.items.select("item_id", "title"), "item_id").orderBy(order).limit(n))
        buckets: dict[str, int] = {}
        for i in items:
            buckets[i.get("bucket", "top")] = buckets.get(i.get("bucket", "top"), 0) + 1
        found = near.agg(F.count(F.lit(1)).alias("neighbor_count"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("top_similarity"), F.coalesce(F.max("shared"), F.lit(0)).alias("max_shared")).first().asDict() if near is not None else {"neighbor_count": 0}
        seeds = sessions.active_profile(events).count()
        status = "personalized" if found["neighbor_count"] or more.pop("enough", False) else "cold_start"
        return {"personalised": near is not None, "items": items, "count": len(items), "event_count": events.count(), "profile": {"seed_count": seeds}, "collaborative": found, "bucket_counts": buckets, "engine": engine, "status": status, **more}

    def for_you(self, session_id: str, n: int = 10) -> dict:
        n, events = _between("n", n, 1, 50), self._events(session_id)
        if not events.filter("item_id is not null").limit(1).count():
            best = scoring.leaderboard(self.data.scores, n).withColumn("position", F.monotonically_increasing_id())
            if self.data.has_tags:
                best = selection.diversify(self.data.scores.withColumn("session_id", F.lit(session_id)).withColumn("value", F.col("comprehensive_score")), n)
            return self._answer(events, best, "position", n, None, "top")
        profile, formula = sessions.active_profile(events), cf.SMALL_SESSION if self.data.has_tags else cf.LARGE_SESSION
        near = cf.profile_neighbors(profile, self.data.ratings, formula).persist()
        try:
            return self._by_taste(events, profile, near, n) if self.data.has_tags else self._by_ratings(events, profile, near, n)
        finally:
            near.unpersist()

    def _filled(self, events: DataFrame, best: DataFrame, n: int) -> DataFrame:
        """best(session_id, item_id, position, ...) with the best-scored items that the session has not met, up to n."""
        scores = self.data.scores.select("item_id", F.col("comprehensive_score").alias("score"))
        met = events.filter(F.col("event_type").isin("view", "like", "dislike") & F.col("item_id").isNotNull()).select("item_id").distinct()
        start = events.select("session_id").distinct().join(best.select("session_id", "item_id", "position"), "session_id", "left")
        filled = selection.backfill(start, scores.join(met, "item_id", "left_anti"), n).filter("item_id is not null")
        return filled.join(best.drop("position"), ["session_id", "item_id"], "left").withColumn("bucket", F.coalesce("bucket", F.lit("top")))

    def _by_ratings(self, events: DataFrame, profile: DataFrame, near: DataFrame, n: int) -> dict:
        """By the reranker if there is one and it knows the session, else by neighbours; backfilled from the leaderboard."""
        if self.artifact and profile.limit(1).count():
            a = self.artifact
            best = recommend.recommend_online(events, self.data.scores, self.data.ratings, a["weights"], n, a["limit"], a["model"], a["k"], a["priors"]).persist()
            if best.limit(1).count():
                routes = sorted({s for r in best.select("sources").collect() for s in r.sources})  # at most n rows
                shown = self._filled(events, best.withColumnRenamed("rank", "position"), n)
                return self._answer(events, shown, "position", n, near, "stacked_reranker", enough=profile.count() >= 3, routes=routes, model={"candidate_limit": a["limit"], "factors": a["model"] is not None, "offline_metric": a["metric"]})
        shared = cf.score_candidates(near, self.data.ratings, profile, cf.LARGE_SESSION)
        best = top(shared, "session_id", [F.desc("score"), F.asc("item_id")], n).withColumnRenamed("rank", "position").withColumn("bucket", F.lit("collaborative"))
        return self._answer(events, self._filled(events, best, n), "position", n, near, "user_user")

    def _by_taste(self, events: DataFrame, profile: DataFrame, near: DataFrame, n: int) -> dict:
        """By the session's memory of genres and tags, what neighbours like, and something new; with a sentence that says why."""
        shared = cf.score_candidates(near, self.data.ratings, profile, cf.SMALL_SESSION)
        own = vectors.content_vectors(self.data.scores)
        preferences = sessions.preference_vectors(sessions.event_weights(sessions.recent(events)), own).persist()
        cosines = sessions.session_cosines(preferences, own)
        found = sessions.for_you_candidates(cosines, self.data.scores, events.filter("item_id is not null"), n, shared)
        listed = found.join(self.data.scores.select("item_id", "genres", "tags"), "item_id")
        liked = profile.filter("rating >= 3.6").join(self.data.scores.select("item_id", F.explode("genres").alias("genre")), "item_id").groupBy("session_id", "genre").count()
        liked = top(liked, "session_id", [F.desc("count"), F.asc("genre")], 5).select("session_id", "genre", "rank")
        shown = recommend.reasons(selection.interleave(selection.blend(listed, liked, n)).join(shared.select("session_id", "item_id", "support"), ["session_id", "item_id"], "left"))
        weights = preferences.filter(F.col("feature").startswith("tag:")).select(F.substring("feature", 5, 1000).alias("tag"), F.col("value").alias("weight"))
        expansions = _rows(vectors.explain_expansion(weights, self._neighbours()))
        return self._answer(events, shown, "shown", n, near, "memory", expansions=expansions)

    def _neighbours(self) -> DataFrame:
        """Neighbours of all tags, worked out once."""
        if not hasattr(self, "_near_tags"):
            self._near_tags = vectors.tag_semantics(scoring.tag_details(self.data.tags).select("item_id", "tag", "weight"), n=30).persist()
        return self._near_tags

    def user(self, user_id: int, n: int = 10) -> dict:
        """For a known user, from its newest ratings."""
        best = recommend.recommend_user(self.data.ratings, int(user_id), _between("n", n, 1, 50))
        items = _rows(best.join(self.data.items.select("item_id", "title"), "item_id").orderBy("rank"))
        return {"user_id": int(user_id), "items": items, "count": len(items), "engine": "known_user", "status": "personalized" if items else "cold_start"}

    def tag_semantics(self, tag: str, n: int = 10) -> dict:
        if not self.data.has_tags:
            raise Unsupported("this dataset has no tags")
        near = self._neighbours().filter((F.col("tag") == tag.strip().lower()) & (F.col("rank") <= _between("n", n, 1, 30)))
        return {"tag": tag, "neighbours": _rows(near.orderBy("rank"))}


ROUTES = {"health": "health", "dashboard": "dashboard", "top": "top", "search": "search", "recommend": "recommend", "for-you": "for_you", "tag-semantics": "tag_semantics", "events": "event", "user": "user"}


def respond(services: Service | dict[str, Service], method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """A request's status and answer: 400 for bad values, 404 and 405 for bad routes, 501 for what a dataset lacks, 500 for missing files.

    Of several services the request's `dataset` chooses, by default the first.
    """
    services = services if isinstance(services, dict) else {services.data.name: services}
    default = next(iter(services))
    url = urlsplit(target)
    name = url.path.removeprefix("/api/").strip("/")
    if not url.path.startswith("/api/") or name not in ROUTES:
        return 404, {"detail": f"no route {url.path}"}
    if (method == "POST") != (name == "events"):
        return 405, {"detail": f"{method} does not go with {url.path}"}
    try:
        values = json.loads(body or b"{}") if method == "POST" else {k: int(v) if k in ("n", "user_id") else v for k, v in parse_qsl(url.query)}
        if (asked := values.pop("dataset", default)) not in services:
            raise ValueError(f"unknown dataset: {asked}")
        for alias in ("movie_id", "movieId"):
            if alias in values:
                values["item_id"] = values.pop(alias)
        found = getattr(services[asked], ROUTES[name])(**values)
        return 200, found | {"default": default, "available": list(services)} if name == "health" else found
    except (Unsupported, NotImplementedError) as e:
        return 501, {"detail": str(e)}
    except (ValueError, TypeError) as e:
        return 400, {"detail": str(e)}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 500, {"detail": str(e)}


def serve(services: Service | dict[str, Service], port: int = 8000) -> ThreadingHTTPServer:
    """A server on the loopback address; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, found = respond(services, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            raw = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *a) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
