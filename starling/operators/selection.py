"""Greedy selections that look at what is already chosen: diversification, quotas, relevance against novelty, interleaving.

They are sequential, so each session's few hundred candidates go through one Arrow group.
"""

from __future__ import annotations

import json
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.numeric import top

WINDOW, BLEND_WINDOW = 120, 260


def _list(name: str) -> Column:
    """A null list is an empty one."""
    return F.coalesce(name, F.array().cast("array<string>")).alias(name)


def diversify(candidates: DataFrame, n: int, window: int = WINDOW) -> DataFrame:
    """candidates(session_id, item_id, genres, value) -> the n of each session that score best step by step.

    6 more if one of the first three genres is new, 4 less for each time that one was chosen; only the first `window` by value take part.
    """
    first = top(candidates, "session_id", [F.desc("value"), F.asc("item_id")], window).select("session_id", "item_id", _list("genres"), F.col("value").cast("double").alias("value"), "rank")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows, seen, out = group.sort_values("rank").to_dict("records"), {}, []
        while rows and len(out) < n:
            def gain(r):
                own = list(r["genres"])[:3]
                return r["value"] + (6 if any(g not in seen for g in own) else 0) - 4 * sum(seen.get(g, 0) for g in own)

            best = max(range(len(rows)), key=lambda k: (gain(rows[k]), -k))
            row = rows.pop(best)
            for g in list(row["genres"])[:3]:
                seen[g] = seen.get(g, 0) + 1
            out.append((row["session_id"], row["item_id"], row["value"], len(out) + 1))
        return pd.DataFrame(out, columns=["session_id", "item_id", "value", "position"])

    kind = candidates.schema["session_id"].dataType.simpleString()
    return first.groupBy("session_id").applyInPandas(choose, f"session_id {kind}, item_id long, value double, position int")


def mmr(candidates: DataFrame, n: int, weight: float = 0.15, pool: int | None = None) -> DataFrame:
    """candidates(user_id, item_id, relevance, vector) -> (user_id, item_id, position): (1 - w) * relevance - w * the greatest cosine to the chosen."""
    first = top(candidates, "user_id", [F.desc("relevance"), F.asc("item_id")], pool or 20 * n).select("user_id", "item_id", F.col("relevance").cast("double").alias("relevance"), "vector", "rank")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        x = np.stack(group["vector"].to_numpy()).astype(float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        relevance, near, left, out = group["relevance"].to_numpy(), np.full(len(group), -np.inf), np.ones(len(group), bool), []
        while left.any() and len(out) < n:
            gain = (1 - weight) * relevance - weight * np.where(np.isfinite(near), near, 0.0)
            best = int(np.argmax(np.where(left, gain, -np.inf)))
            left[best] = False
            out.append(best)
            near = np.maximum(near, x @ x[best])
        return pd.DataFrame({"user_id": group["user_id"].iloc[0], "item_id": group["item_id"].to_numpy()[out], "position": range(1, len(out) + 1)})

    kind = candidates.schema["user_id"].dataType.simpleString()
    return first.groupBy("user_id").applyInPandas(choose, f"user_id {kind}, item_id long, position int")


def _clamp(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


def targets(n: int, collaborative: bool) -> dict[str, int]:
    """How many of n places each bucket gets."""
    if not collaborative:
        interest = _clamp(round(0.75 * n), 1, n) if n > 0 else 0
        return {"interest": interest, "collaborative": 0, "explore": n - interest}
    c = 0 if n <= 2 else _clamp(round(0.25 * n), 1, n - 1)
    x = 0 if n <= 2 else _clamp(round(0.15 * n), 1, n - 1)
    return {"interest": max(1, n - c - x), "collaborative": c, "explore": x}


# The points of the quota selection, under and over a bucket's target.
BUCKET_POINTS = {"explore": (28, -32), "collaborative": (18, -24), "interest": (10, -12)}


def blend(candidates: DataFrame, profile_genres: DataFrame, n: int) -> DataFrame:
    """candidates(session_id, item_id, bucket, value, genres, tags), profile_genres(session_id, genre, rank) -> n of each session by quota.

    (session_id, item_id, bucket, value, position). Buckets are filled in the order collaborative, interest, explore, then what is left.
    """
    ranked = candidates.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "bucket").orderBy(F.desc("value"), "item_id"))).filter(F.col("n") <= BLEND_WINDOW)
    liked = profile_genres.filter("rank <= 5").groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("genre", "rank"))).alias("liked"))
    rows = ranked.join(liked, "session_id", "left").select("session_id", "item_id", "bucket", F.col("value").cast("double").alias("value"), _list("genres"), _list("tags"), "n", F.to_json("liked").alias("liked"))

    kind = candidates.schema["session_id"].dataType

    def choose(group: pa.Table) -> pa.Table:
        liked = group.column("liked")[0].as_py()
        columns = (group.column(c).to_pylist() for c in ("bucket", "n", "item_id", "value", "genres", "tags"))
        found = _by_quota(sorted(zip(*columns), key=lambda r: r[:2]), json.loads(liked) if liked else {}, n)
        types = {"session_id": to_arrow_type(kind), "item_id": pa.int64(), "bucket": pa.string(), "value": pa.float64(), "position": pa.int32()}
        first = group.column("session_id")[0].as_py()
        values = [[first] * len(found), [r[2] for r in found], [r[0] for r in found], [r[3] for r in found], range(1, len(found) + 1)]
        return pa.table({c: pa.array(list(x), t) for (c, t), x in zip(types.items(), values)})

    return rows.groupBy("session_id").applyInArrow(choose, f"session_id {kind.simpleString()}, item_id long, bucket string, value double, position int")


def _by_quota(rows: list[tuple], liked: dict[str, int], n: int) -> list[tuple]:
    """The chosen of rows(bucket, n, item_id, value, genres, tags), which are in the order of bucket and n.

    Rows of one bucket, genres and tags have the same points besides their value, so only the first that is left of each is looked at.
    """
    rows = [(*r, (r[0], tuple(r[4]), tuple(r[5]))) for r in rows]
    own = {bucket: [r for r in rows if r[0] == bucket] for bucket in BUCKET_POINTS}
    target = targets(n, bool(own["collaborative"]))
    cap, genres, tags, counts, gone, out = max(2, ceil(0.5 * n)), {}, {}, dict.fromkeys(target, 0), set(), []

    def gain(r):
        first, (under, over) = r[4][:3], BUCKET_POINTS[r[0]]
        score = r[3] + (under if counts[r[0]] < target[r[0]] else over) + (8 if any(g not in genres for g in first) else 0)
        score += max([10 - liked[g] for g in r[4] if g in liked and g not in genres], default=0)
        return score - 8 * sum(genres.get(g, 0) for g in first) - 42 * sum(genres.get(g, 0) >= cap for g in first) - 1.4 * sum(tags.get(t, 0) for t in r[5][:10])

    def take(pool) -> bool:
        heads = {}
        for r in [r for r in pool if r[2] not in gone][:BLEND_WINDOW]:
            heads.setdefault(r[6], r)
        if not heads:
            return False
        chosen = max(heads.values(), key=lambda r: (gain(r), -r[1]))
        counts[chosen[0]] += 1
        for g in chosen[4]:
            genres[g] = genres.get(g, 0) + 1
        for t in chosen[5][:12]:
            tags[t] = tags.get(t, 0) + 1
        gone.add(chosen[2])
        out.append(chosen)
        return True

    for bucket in ("collaborative", "interest", "explore"):
        while counts[bucket] < target[bucket] and len(out) < n and take(own[bucket]):
            pass
    while len(out) < n and take(rows):
        pass
    return out


def interleave(chosen: DataFrame) -> DataFrame:
    """chosen(session_id, item_id, bucket, position) in turns of two interest, one collaborative and one explore."""
    rn = F.row_number().over(Window.partitionBy("session_id", "bucket").orderBy("position")) - 1
    slot = F.when(F.col("bucket") == "interest", F.floor(F.col("rn") / 2)).otherwise(F.col("rn"))
    turn = F.when(F.col("bucket") == "interest", 0).when(F.col("bucket") == "collaborative", 1).otherwise(2)
    rows = chosen.withColumn("rn", rn).withColumns({"slot": slot, "turn": turn})
    return rows.withColumn("shown", F.row_number().over(Window.partitionBy("session_id").orderBy("slot", "turn", "rn"))).drop("rn", "slot", "turn")


def backfill(chosen: DataFrame, scores: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    """Lists of fewer than n items are filled from the best scores(item_id, score) that they lack."""
    best = scores.orderBy(F.desc("score"), "item_id").limit(2 * n).select("item_id", "score")
    more = chosen.select(key).distinct().crossJoin(F.broadcast(best)).join(chosen.select(key, "item_id"), [key, "item_id"], "left_anti")
    more = more.withColumn("position", 1_000_000 + F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "item_id")))
    every = chosen.select(key, "item_id", F.col("position").cast("long").alias("position")).unionByName(more.select(key, "item_id", F.col("position").cast("long").alias("position")))
    return every.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("position"))).filter(F.col("position") <= n)
