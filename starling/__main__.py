"""Command line: python -m starling --dataset tables --data FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import drivers
from .operators import evaluation as ev, factors, scoring, tuning
from .pipelines import Dataset, load
from .service import Service, serve

LARGE_ONLY = ("large-search", "bayes-search", "rerank", "neural-rerank")


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="starling")
    found.add_argument("--dataset", default="tables")
    found.add_argument("--data", required=True)
    commands = found.add_subparsers(dest="command", required=True)
    commands.add_parser("demo")
    add = commands.add_parser("top")
    add.add_argument("-n", type=int, default=10)
    add.add_argument("--algorithm", choices=["heap", "merge"], default="heap")
    add.add_argument("--mode", choices=list(scoring.SCORE_MODES), default="default")
    add = commands.add_parser("search")
    add.add_argument("kind", choices=["title", "genre", "tag"])
    add.add_argument("query")
    add.add_argument("-n", type=int, default=10)
    add = commands.add_parser("recommend")
    add.add_argument("title")
    add.add_argument("-n", type=int, default=10)
    commands.add_parser("experiment")
    add = commands.add_parser("user")
    add.add_argument("user_id", type=int)
    add.add_argument("-n", type=int, default=10)
    for name in LARGE_ONLY:
        add = commands.add_parser(name)
        add.add_argument("--output-dir", default=f"output/{name}")
        add.add_argument("--profile", choices=["smoke", "standard"], default="standard")
        add.add_argument("--max-users", type=int)
        if name == "bayes-search":
            add.add_argument("--mode", choices=list(tuning.SPACES), default="hybrid")
            add.add_argument("--trials", type=int)
        if name == "rerank":
            add.add_argument("--recall-params")
            add.add_argument("--negative-sampling", choices=["hybrid_hard", "explicit_hard"])
            add.add_argument("--blend-mode", choices=["value", "rank"])
            add.add_argument("--min-blend-precision-gain", type=float)
    add = commands.add_parser("serve")
    add.add_argument("--port", type=int, default=8000)
    add.add_argument("--events")
    add.add_argument("--artifact")
    add.add_argument("--runtime")
    return found


def experiment(data: Dataset, repeats: int = 3) -> list[tuple[str, int, float]]:
    """Best of `repeats` seconds for rankings of growing parts of the catalogue."""
    out = []
    for n in (100, 500, 1000, 5000):
        part = data.scores.orderBy("item_id").limit(n).persist()
        part.count()
        for name, work in (("sort", lambda p: p.orderBy(F.desc("comprehensive_score"), "item_id")), ("top", lambda p: scoring.leaderboard(p, 10))):
            best = min(_timed(work(part)) for _ in range(repeats))
            out.append((name, n, round(best, 4)))
        part.unpersist()
    return out


def _timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def run(args: argparse.Namespace, spark: SparkSession) -> object:
    data = load(spark, args.dataset, args.data)
    if args.command in LARGE_ONLY and data.name == "small":
        raise NotImplementedError(f"{args.command} needs a large dataset")
    service = Service(data, getattr(args, "events", None), getattr(args, "artifact", None), getattr(args, "runtime", None))
    smoke = getattr(args, "profile", None) == "smoke"
    config = ev.Config(max_users=40, pool=300) if smoke else ev.Config()
    if getattr(args, "max_users", None):
        config = replace(config, max_users=args.max_users)
    match args.command:
        case "demo":
            return {"dashboard": service.dashboard(), "top": service.top(5)}
        case "top":
            return service.top(args.n, args.algorithm, args.mode)
        case "search":
            return service.search(args.kind, args.query, args.n)
        case "recommend":
            return service.recommend(args.title, args.n)
        case "user":
            return service.user(args.user_id, args.n)
        case "experiment":
            return experiment(data)
        case "rerank" | "neural-rerank":
            return drivers.learn(data, args.output_dir, config, _learning(args, spark, smoke))
        case "large-search":
            return [r.asDict() for r in drivers.large_search(data, args.output_dir, drivers.SMOKE if smoke else drivers.SearchPlan()).collect()]
        case "bayes-search":
            return drivers.bayes_search(data, args.output_dir, args.mode, args.trials or (5 if smoke else 30), config)
        case "serve":
            serve(service, args.port).serve_forever()


def _learning(args: argparse.Namespace, spark: SparkSession, smoke: bool) -> drivers.Learning:
    """The settings of a learning command: those of its profile, and what the flags change."""
    found = drivers.Learning(neural=args.command == "neural-rerank", negatives="hybrid_hard" if smoke else "explicit_hard", factors=factors.Config(16, 5) if smoke else factors.Config())
    if getattr(args, "recall_params", None):
        found = replace(found, **drivers.load_recall_settings(spark, args.recall_params))
    given = {"negatives": getattr(args, "negative_sampling", None), "blend": getattr(args, "blend_mode", None), "least_gain": getattr(args, "min_blend_precision_gain", None)}
    return replace(found, **{k: v for k, v in given.items() if v is not None})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("starling").getOrCreate()
    try:
        print(json.dumps(run(args, spark), default=str))
        return 0
    except (NotImplementedError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
