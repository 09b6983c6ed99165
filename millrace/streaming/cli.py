"""Command line: validate, once, run, status, and dbt check or convert."""

from __future__ import annotations

import argparse
import json
import signal
import sys
from collections import Counter

from ..errors import MillraceError
from . import config as C
from . import metrics
from .supervisor import Supervisor, status


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Moves rows from table to table, exactly once.")
    commands = p.add_subparsers(dest="command", required=True)
    for name, said in (("validate", "check the settings and every query"), ("once", "run until every source has no more"), ("run", "run until stopped"), ("status", "how far each pipeline is")):
        c = commands.add_parser(name, help=said)
        c.add_argument("-c", "--config", default="pipelines.toml")
        if name in ("once", "run"):
            c.add_argument("--metrics-addr", help="host:port to serve metrics on")
            c.add_argument("--no-publish", action="store_true", help="send no messages")
            c.add_argument("-t", "--target", help="output of profiles.yml whose catalog is asked again for locations before each poll")
            c.add_argument("--profile")
            c.add_argument("--profiles-dir")
            c.add_argument("-s", "--select", action="append", default=[], help="pipelines by name")
    d = commands.add_parser("dbt", help="work with a dbt manifest").add_subparsers(dest="dbt", required=True)
    for name in ("check", "convert"):
        c = d.add_parser(name)
        c.add_argument("manifest")
        c.add_argument("-s", "--select", action="append", default=[], help="models by name")
        c.add_argument("-t", "--target", help="output of profiles.yml whose catalog gives locations")
        c.add_argument("--profile")
        c.add_argument("--profiles-dir")
        c.add_argument("--uri-template")
        c.add_argument("--meta-prefix", default="millrace")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    say = lambda x: print(x, file=out)
    try:
        if args.command == "dbt":
            return _dbt(args, spark or session(), say)
        settings = C.load(args.config)
        found = C.resolve(settings, spark or session())
        for name, why in sorted(found.rejected.items()):
            say(f"{name}: can't run: {why}")
        for name, why in sorted(found.unpublished.items()):
            say(f"{name}: runs without its publication: {why}")
        if args.command == "validate":
            for r in found.pipelines:
                say(f"{r.name}: ok")
            return int(bool(found.rejected))
        if args.command == "status":
            for s in status(found):
                say(json.dumps(s))
            return 0
        if not found.pipelines:
            say("no pipeline can run")
            return 1
        if args.select:
            found.pipelines = [p for p in found.pipelines if p.name in args.select]
        locate = None
        if args.target or args.profile:
            from ..sources import catalog

            locate = catalog.Located(catalog.locator(catalog.connection(args.profiles_dir, args.profile, args.target)))
        supervisor = Supervisor(spark or session(), settings, found, publish=not args.no_publish, locate=locate)
        server = metrics.serve(args.metrics_addr, supervisor.page) if args.metrics_addr else None
        try:
            if args.command == "run":
                for s in (signal.SIGTERM, signal.SIGINT):
                    signal.signal(s, lambda *_: supervisor.stop())
            failed = supervisor.run(once=args.command == "once")
        finally:
            if server:
                server.shutdown()
        for name, e in sorted(failed.items()):
            say(f"{name}: {e}")
        return int(bool(failed or found.rejected))
    except MillraceError as e:
        say(f"error: {e}")
        return 2


def _dbt(args, spark, say) -> int:
    from ..plans import dbt

    manifest = dbt.load(args.manifest, args.meta_prefix)
    verdicts = [v for v in dbt.analyze_all(manifest, spark) if not args.select or v.name in args.select]
    if args.dbt == "check":
        for v in verdicts:
            say(f"{v.kind:<11} {v.name}" + (f": {v.reason}" if v.reason else ""))
        for kind, n in sorted(Counter(v.kind for v in verdicts).items()):
            say(f"{n} {kind}")
        return 0
    locate = None
    if args.target or args.profile:
        from ..sources import catalog

        locate = catalog.locator(catalog.connection(args.profiles_dir, args.profile, args.target))
    made = dbt.convert(manifest, C.StorageConfig(uri_template=args.uri_template), spark, locate)
    say(dbt.to_toml([p for p in made if not args.select or p.name in args.select]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
