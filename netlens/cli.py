"""Command line: ``python -m netlens.cli analyze FILE``."""

import argparse
import sys

from netlens.operators import indicators
from netlens.plans import report as reports
from netlens.plans.analysis import Settings, analyze
from netlens.session import local_session
from netlens.sources import intel


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netlens")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="report on a capture")
    a.add_argument("file")
    a.add_argument("--json", help="write the report as JSON; - for standard output")
    a.add_argument("--html", help="write the report as a page")
    a.add_argument("--ioc", action="append", default=[], help="indicator list")
    a.add_argument("--intel", help="folder of cached feeds")
    a.add_argument("--limit", type=int)
    a.add_argument("--packets", action="store_true", help="print a line for each packet")
    a.add_argument("--fail-on", choices=("info", "low", "medium", "high"))
    a.add_argument("--top", type=int, default=20)
    a.add_argument("--beacon-jitter", type=float, default=0.20)
    a.add_argument("--beacon-packets", type=int, default=8)
    a.add_argument("--subdomains", type=int, default=40)
    a.add_argument("--scan-ports", type=int, default=15)
    u = commands.add_parser("intel", help="fetch feeds into a folder")
    u.add_argument("folder")
    u.add_argument("--feed", action="append", choices=list(intel.FEEDS))
    u.add_argument("--key")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    if args.command == "intel":
        failed = intel.update_cache(spark, args.folder, args.feed or list(intel.FEEDS), args.key)
        for feed, why in failed.items():
            print(f"{feed}: {why}", file=sys.stderr)
        return 1 if failed else 0
    sets = [intel.read_list(spark, path) for path in args.ioc]
    cached = intel.load_cache(spark, args.intel) if args.intel else None
    sets += [cached] if cached is not None else []
    settings = Settings(
        top=args.top,
        beacon_jitter=args.beacon_jitter,
        beacon_packets=args.beacon_packets,
        subdomains=args.subdomains,
        scan_ports=args.scan_ports,
    )
    aligned = [s.select("kind", "value", "source", "tag", s["ord"].cast("string").alias("ord")) for s in sets]
    a = analyze(spark, args.file, settings, indicators.union(*aligned) if aligned else None, args.limit)
    if args.packets:
        from netlens.decode.layers import summary_line

        for r in a.packets.orderBy("index").select(summary_line().alias("line")).toLocalIterator():
            print(r.line)
    found = reports.build(a, args.file)
    if args.html:
        with open(args.html, "w") as f:
            f.write(reports.to_html(found))
    if args.json and args.json != "-":
        with open(args.json, "w") as f:
            f.write(reports.to_json(found))
    print(reports.to_json(found) if args.json == "-" else reports.to_text(found))
    return reports.gate(a.findings(), args.fail_on) if args.fail_on else 0


if __name__ == "__main__":
    sys.exit(main())
