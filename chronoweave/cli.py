"""Command line: run the queries of HCL or JSON files over a store, or serve it.

    python -m chronoweave.cli --store DIR --path FILE_OR_DIRECTORY [--mode query|replay] [--json] [--merge]
    python -m chronoweave.cli --store DIR --serve [--port 8080]
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from chronoweave.engine import Engine, as_json
from chronoweave.plans import hcl
from chronoweave.plans.spec import SpecError, query_from_json, replay_from_json


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", required=True, help="folder of the event store")
    p.add_argument("--path", help="an HCL or JSON file, or a directory of HCL files")
    p.add_argument("--mode", choices=("query", "replay"), default="query")
    p.add_argument("--json", action="store_true", help="print results as JSON")
    p.add_argument("--out", help="write each result's rows as Parquet below this folder instead of printing them")
    p.add_argument("--merge", action="store_true", help="read all files of a directory as one query")
    p.add_argument("--serve", action="store_true", help="serve HTTP instead")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--batch-events", type=int, default=1000, help="events that the server writes at a time, at least every five seconds")
    args = p.parse_args(argv)
    if not args.serve and not args.path:
        p.error("--path is required")
    return args


def run_text(engine: Engine, text: str, mode: str, out: str | None = None) -> dict:
    is_hcl = hcl.content_kind(text) == "hcl"
    if mode == "replay":
        spec = hcl.parse_replay(text) if is_hcl else replay_from_json(text)
        found = engine.replay(spec)
    else:
        spec = hcl.parse_query(text) if is_hcl else query_from_json(text)
        found = engine.query(spec)
    if out:
        return {"result": engine.write(found, out), "unit": found.unit, "metadata": found.metadata}
    return as_json(found, spec.timeline_id)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("chronoweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.store)
    if args.serve:
        from chronoweave.sources.http import server
        from chronoweave.streaming.batches import MicroBatcher

        with MicroBatcher(engine.store, args.batch_events) as batcher, server(engine, args.host, args.port, batcher) as s:
            s.serve_forever()
        return 0
    texts = {args.path: hcl.merged(args.path)} if args.merge else {str(f): f.read_text() for f in hcl.files(args.path)}
    failed = not texts
    for name, text in texts.items():
        try:
            out = run_text(engine, text, args.mode, f"{args.out}/{Path(name).stem}" if args.out else None)
        except (SpecError, ValueError) as e:
            print(f"{name}: {e}", file=sys.stderr)
            failed = True
            continue
        print(json.dumps({"file": name} | out, default=str) if args.json else f"{name}\n  result: {out['result']}\n  unit: {out['unit']}")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
