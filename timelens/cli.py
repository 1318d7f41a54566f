"""``python -m timelens``: the operators over folders of role tables."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens import schemas
from timelens.functions.timeparse import TimeWindow
from timelens.functions.vector import hash_embed
from timelens.operators import catalog, fuse, search, statechange, tracks, vectors
from timelens.plans import ingest, planner
from timelens.sources import sidecars, trace, versions
from timelens.streaming import watch


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="timelens", description=__doc__)
    parser.add_argument("--workdir", default=".", help="folder with a Parquet folder for each role table")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("query", "textsearch", "transcript", "caption", "ocr", "actions", "ask"):
        v = verbs.add_parser(verb)
        v.add_argument("text")
        v.add_argument("-k", type=int, default=10)
    verbs.choices["transcript"].add_argument("--speaker")
    for verb in ("objects", "count"):
        v = verbs.add_parser(verb)
        v.add_argument("text")
        v.add_argument("--min-frames", type=int, default=2)
    agg = verbs.add_parser("aggregate")
    agg.add_argument("op", choices=("count", "events", "histogram"))
    agg.add_argument("category")
    for flag in ("--start", "--end", "--tz"):
        agg.add_argument(flag, required=True)
    agg.add_argument("--cameras", nargs="*")
    agg.add_argument("--bucket", default="1h")
    agg.add_argument("--limit", type=int, default=100)
    agg.add_argument("--min-frames", type=int, default=2)
    scan = verbs.add_parser("scan", help="how often labels change")
    scan.add_argument("--prompt-key")
    stale = verbs.add_parser("stale")
    stale.add_argument("fingerprints", help="JSON object: role to current fingerprint")
    plan = verbs.add_parser("reprocess")
    plan.add_argument("fingerprints")
    w = verbs.add_parser("watch")
    w.add_argument("events", help="path of motion sidecars")
    w.add_argument("--now", type=float, required=True)
    w.add_argument("--max-windows", type=int, default=50)
    probe = verbs.add_parser("motion-probe")
    probe.add_argument("events")
    probe.add_argument("start", type=float)
    probe.add_argument("end", type=float)
    t = verbs.add_parser("trace", help="a folder's runs, or one of them as it is")
    t.add_argument("path")
    t.add_argument("--run")
    t.add_argument("--keep", type=int)
    t.add_argument("--older-than-days", type=float)
    t.add_argument("--clear", action="store_true")
    remove = verbs.add_parser("remove")
    remove.add_argument("ident")
    migrate = verbs.add_parser("migrate-layout")
    migrate.add_argument("target")
    return parser


def _role(spark: SparkSession, args: argparse.Namespace, name: str) -> DataFrame:
    return versions.open_role(spark, f"{args.workdir}/{name}", name)


def _videos(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return _role(spark, args, "videos").withColumn("video_id", F.col("id"))


def _tracks(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return _role(spark, args, "object_tracks").withColumnRenamed("id", "track_id")


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | dict:
    """A verb's result."""
    verb = args.verb
    if verb in ("query", "textsearch"):
        space = "frame" if verb == "query" else "text"
        usable = vectors.usable(_role(spark, args, "vectors"), space, "hash", 256)
        return vectors.with_catalog(vectors.cosine_top_k(usable, hash_embed(args.text), args.k, "video_id", "timestamp").withColumn("source_uri", F.col("payload")["source_uri"]), _videos(spark, args)).drop("embedding")
    if verb == "transcript":
        return search.search_transcripts(_role(spark, args, "transcripts"), args.text, args.k, args.speaker)
    if verb == "caption":
        return search.search_captions(_role(spark, args, "segments"), args.text, args.k)
    if verb == "ocr":
        return search.search_ocr(_role(spark, args, "ocr_results"), args.text, args.k)
    if verb == "actions":
        return search.search_actions(_role(spark, args, "action_events"), args.text, args.k)
    if verb == "objects":
        return tracks.query_objects(_role(spark, args, "object_detections"), args.text)
    if verb == "count":
        return tracks.count_objects_of(_tracks(spark, args), args.text, args.min_frames)
    if verb == "aggregate":
        window = TimeWindow(args.start, args.end, args.tz)
        op = {"count": "count_objects", "events": "list_events", "histogram": "timeline_histogram"}[args.op]
        extra = {"events": {"limit": args.limit}, "histogram": {"bucket": args.bucket}}.get(args.op, {})
        request = {"category": args.category, "start": window.start, "end": window.end, "tz": window.tz, "min_frames": args.min_frames, **({"cameras": args.cameras} if args.cameras is not None else {}), **extra}
        got = planner.dispatch_aggregation({"op": op, "args": request}, _tracks(spark, args), _videos(spark, args))
        return got.frame if got.frame is not None else {"note": got.note, "caveats": got.caveats}
    if verb == "ask":
        gatherers = {
            "caption_search": lambda p: fuse.from_captions(search.search_captions(_role(spark, args, "segments"), p.search_terms, args.k)),
            "transcript_search": lambda p: fuse.from_transcripts(search.search_transcripts(_role(spark, args, "transcripts"), p.search_terms, args.k)),
            "ocr_search": lambda p: fuse.from_ocr(search.search_ocr(_role(spark, args, "ocr_results"), p.search_terms, args.k)),
            "action_query": lambda p: fuse.from_actions(search.search_actions(_role(spark, args, "action_events"), p.search_terms, args.k)),
            "object_query": lambda p: fuse.from_distinct_counts(tracks.count_objects_of(_tracks(spark, args), p.search_terms)),
        }
        return planner.ask(args.text, gatherers, aggregate_by=lambda p: planner.dispatch_aggregation(p, _tracks(spark, args), _videos(spark, args)))
    if verb == "scan":
        seen = _role(spark, args, "observations")
        return statechange.analyze_timelines(seen if args.prompt_key is None else seen.filter(F.col("prompt_key") == args.prompt_key))
    if verb in ("stale", "reprocess"):
        provenance = _role(spark, args, "role_provenance")
        found = catalog.stale_roles(_videos(spark, args), provenance, json.loads(args.fingerprints))
        return found if verb == "stale" else catalog.reprocess_plan(found, provenance, {"captions": ["text"]})
    if verb == "watch":
        events = sidecars.read_sidecars(spark, args.events, "motion")
        cameras = _role(spark, args, "cameras").withColumnRenamed("id", "camera_id")
        return watch.catch_up(cameras, events, args.now, watch.WatchRules(max_windows=args.max_windows)).windows
    if verb == "motion-probe":
        return sidecars.motion_events(sidecars.read_sidecars(spark, args.events, "motion"), args.start, args.end)
    if verb == "trace":
        if args.clear or args.keep is not None or args.older_than_days is not None:
            return {"removed": trace.prune(spark, args.path, args.keep, args.older_than_days, args.clear)}
        if args.run is not None:
            found = trace.find_run(spark, args.path, args.run)
            return {"run": args.run, "trace": found and trace.render(spark, found)}
        return trace.newest_runs(trace.list_runs(trace.read_lines(spark, args.path)))
    if verb == "remove":
        gone = catalog.resolve_ident(_videos(spark, args), args.ident)
        held = gone.select("video_id").collect()  # one row at most
        if not held:
            return {"removed": 0}
        return {"removed": 1, "rows": ingest.remove(args.workdir, spark.createDataFrame(held, "video_id string"), [n for n in schemas.SCHEMAS if n not in ("cameras", "jobs")])}
    if verb == "migrate-layout":
        catalog.migrate_layout(_role(spark, args, "vectors"), args.target)
        return {"written": args.target}
    raise ValueError(verb)


def main(argv: Sequence[str] | None = None) -> int:
    from timelens.session import build_session

    args = build_parser().parse_args(argv)
    got = run(args, build_session())
    if isinstance(got, DataFrame):
        got.show(200, truncate=False)
    else:
        print(json.dumps({k: v for k, v in got.items() if k != "plan"}, default=str, indent=2))
    return 0
