"""The command line: ``python -m siltstone`` snapshots, inspect, metrics, compact or prune a store."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .coordinator import Reader
from .database import Database, Snapshots
from .inspection import Inspector, decoded_key, samples_frame
from .options import Config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltstone")
    out.add_argument("--config", help="a JSON, TOML, INI or YAML file of options")
    what = out.add_subparsers(dest="what", required=True)
    for name, text in (("snapshots", "a shard's snapshots"), ("metrics", "a shard's measures"), ("compact", "fold a shard's segments"), ("maintain", "drop, fold and delete what a schedule should"), ("vacuum", "delete what nothing names")):
        what.add_parser(name, help=text).add_argument("path")
    prune = what.add_parser("prune", help="expire one snapshot of a shard")
    prune.add_argument("path")
    prune.add_argument("id", type=int)
    look = what.add_parser("inspect", help="rows of a global snapshot")
    look.add_argument("path", help="the coordinator's folder")
    look.add_argument("--snapshot", type=int)
    look.add_argument("--bucket", type=int, default=0)
    look.add_argument("--prefix", default="")
    look.add_argument("--after")
    look.add_argument("--key", action="append")
    look.add_argument("--encoding", default="utf8")
    look.add_argument("--limit", type=int)
    return out


def run(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """The lines that the command prints."""
    a = parser().parse_args(arguments)
    config, unknown = Config.load(a.config) if a.config else (Config(), [])
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    out = [f"unknown option: {u}" for u in unknown]
    if a.what == "inspect":
        inspector = Inspector(Reader(spark, a.path, a.snapshot, config))
        if a.key:
            return out + [json.dumps(x) for x in inspector.lookup([(a.bucket, k) for k in a.key], a.encoding)]
        after = None if a.after is None else decoded_key(a.after, a.encoding)
        return [*out, json.dumps(inspector.scan(a.bucket, decoded_key(a.prefix, a.encoding), after, a.limit))]
    if a.what == "prune":
        return [*out, json.dumps({"expired": Snapshots(spark, config.place("snapshot", a.path)).expire(a.id)})]
    db = Database.resume(spark, a.path, config)
    if a.what == "snapshots":
        return out + [json.dumps({"id": s.id, "last_seq": s.last_seq, "seconds": s.seconds, "bytes": s.data_size, "retained": s.retained}) for s in db.list_snapshots()]
    if a.what == "metrics":
        return out + [json.dumps(r.asDict()) for r in samples_frame(spark, db.metrics()).collect()]
    if a.what == "compact":
        return [*out, json.dumps({"version": db.compact().version})]
    if a.what == "maintain":
        return [*out, json.dumps(db.maintain())]
    return [*out, json.dumps({"deleted": db.vacuum()})]


if __name__ == "__main__":
    print("\n".join(run()))
